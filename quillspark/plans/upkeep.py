"""Queries of tokens with particles, of incremental tables and of what stands out in the notes' graph, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import index, insights, updates
from quillspark.plans.notes import KNOWN, _graph
from quillspark.plans.notes_oracles import _GRAPH
from quillspark.plans.vault import vault
from quillspark.plans.vault_oracles import _V
from quillspark.session import table


def _docs(spark, d):
    return table(spark, d, "documents")


def stem_counts(spark, d):
    """Terms of the app's tokenizer over all texts, with a Korean word and a date in every third."""
    extra = F.when(F.col("doc_id") % 3 == 0, " 전투시스템에서는 3일").otherwise("")
    t = F.col("t")
    docs = _docs(spark, d).select(F.concat(F.coalesce("text", F.lit("")), extra).alias("t"))
    # An outer explode: Spark would compute the terms once more to leave out texts without any.
    terms = docs.select(F.explode_outer(F.concat(T.primary_stems(t), T.sub_stems(t))).alias("term"))
    return terms.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


def query_weights(spark, d):
    q = F.concat(F.coalesce("role", F.lit("")), F.lit(" 캐릭터를 "), F.col("turn").cast("string"), F.lit("월"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.weighted_stems(q)).alias("term", "weight"))


def text_segments(spark, d):
    rows = _docs(spark, d).where("lang is not null and source is not null").select("doc_id", T.segments(F.concat(F.lit("see [["), "lang", F.lit("]][["), "source", F.lit("]] [x]"))).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("pos", "s")).select("doc_id", "pos", "s.kind", "s.value")


def incremental_index(spark, d):
    """Document frequencies after every fifth text was shortened and every seventh removed, without reading the others again."""
    docs = _docs(spark, d).where("doc_id is not null")
    before = index.postings(docs).select("doc_id", "term", "tf")
    now = docs.where("doc_id % 5 = 0").withColumn("text", F.substring("text", 1, 60))
    changed = now.select("doc_id").join(index.postings(now).select("doc_id", "term", "tf"), "doc_id", "left")
    found = updates.reindexed(before, changed, docs.where("doc_id % 7 = 0").select("doc_id"))
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def embedding_run(spark, d):
    """The next run of embedding: 150 pending documents at most, in 22 batches of 50,000 characters."""
    rows = _docs(spark, d).where("doc_id is not null").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("etag"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    done = rows.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("etag")).otherwise("old").alias("etag"))
    return updates.work_batches(updates.pending(rows, done, "doc_id", "etag"), "doc_id", F.col("size"), 150, 22, 50_000).select("doc_id", "batch")


def bundle_reuse(spark, d):
    rows = vault(spark, d, "n", "path", "source").where("path is not null")
    before = rows.select("path", F.when(F.col("n") % 4 == 0, "old").otherwise(F.col("source")).alias("etag"))
    return updates.bundle_plan(before.where("path not like '_personal%'"), rows.select("path", F.col("source").alias("etag")).distinct(), "path", "etag")


def people_seen(spark, d):
    """Users' first and last visits after half of the events, then after the rest."""
    e = table(spark, d, "events").select(F.col("user_id").alias("sub"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    half = e.where("event_id % 2 = 0").groupBy("sub").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return updates.seen(half, e.where("event_id % 2 = 1").select("sub", "at"), 3600)


def keyword_store(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("keyword"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("hub"), (F.col("event_id") % 9).cast("string"))).alias("hub"), "event_id")
    old = e.where("event_id < 100").groupBy("keyword").agg(F.min("hub").alias("hub"), F.count("*").alias("hits"))
    return updates.keyword_hits(old, e.where("event_id >= 100").select("keyword", "hub"))


def insight_hubs(spark, d):
    return insights.hubs(_graph(spark, d)[1])


def insight_loose(spark, d):
    docs, edges, _ = _graph(spark, d)
    return insights.loose(docs, edges.where("endswith(dst, '1')"))


def insight_gaps(spark, d):
    return insights.gaps(_graph(spark, d)[2])


def strongest_edges(spark, d):
    edges = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.count("*").alias("refs"))
    return insights.strongest(edges, "refs", 0.1)


def fused_ranks(spark, d):
    """Search by length in one language, a walk by length in all; states and weights from the layout."""
    docs = vault(spark, d, "n", "status", "folder", "source").select(F.col("n").alias("doc_id"), "status", "folder", F.when(F.col("n") % 6 == 0, "skip").when(F.col("n") % 6 == 1, "low").alias("graph_weight"), F.col("source").alias("speaker"))
    rows = _docs(spark, d).where("doc_id is not null").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    found = insights.fused(rows.where("lang = 'fr'").drop("lang"), rows.select("doc_id", F.sqrt("score").alias("score")), docs, "src3")
    return found.select("doc_id", F.round("score", 9).alias("score"))


def relative_hits(spark, d):
    rows = _docs(spark, d).select("doc_id", (F.col("n_chars") / 20000.0).alias("score"))
    return insights.above_relative(rows).select("doc_id")


def small_vault(spark, d):
    """The members of a small vault in full, of a large one the hits alone."""
    docs = _docs(spark, d).where("doc_id is not null")
    hits = docs.where("lang = 'fr'").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    few = insights.whole_if_small(docs.where("doc_id < 5"), hits.where("doc_id < 5"), F.col("n_chars"), 200_000).withColumn("vault", F.lit("small"))
    return few.unionByName(insights.whole_if_small(docs, hits, F.col("n_chars")).withColumn("vault", F.lit("large")))


def open_proposals(spark, d):
    docs, edges, _ = _graph(spark, d)
    path = F.when(F.endswith("doc_id", F.lit("3")), F.concat(F.lit("_agent/"), "path")).otherwise(F.col("path"))
    own = docs.where("startswith(doc_id, 'fr')").select("doc_id")
    return insights.proposals_for(edges, docs.select("doc_id", path.alias("path")), own).select("proposal", F.array_join("targets", ";").alias("targets"))


def batch_dates(spark, d):
    return insights.batch_dates(table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd"))


def matching_notes(spark, d):
    rows = vault(spark, d, "n", "filename", "lang", "source").select("n", "filename", F.array("lang").alias("tags"), F.array(F.concat(F.lit("About "), "source")).alias("headings"))
    return insights.matching(rows, " BOUT SRC1 ").select("n").union(insights.matching(rows, "FR").select("n")).union(insights.matching(rows, "n12").select("n"))


_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s,.\\-_?!;:()\\[\\]{}''\"《》「」【】]+'), lambda x: length(x) > 1)"
_WORDS = "list_filter(regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9_]+'), lambda x: length(x) > 1)"
QUERIES = {
    f.__name__: f
    for f in (
        stem_counts, query_weights, text_segments, incremental_index, embedding_run, bundle_reuse, people_seen, keyword_store, insight_hubs, insight_loose, insight_gaps, strongest_edges, fused_ranks,
        relative_hits, small_vault, open_proposals, batch_dates, matching_notes,
    )
}
ORACLES = {
    "stem_counts": f"""WITH t AS (SELECT unnest({_TOK}) AS term FROM documents UNION ALL SELECT unnest(['전투시스템에서는', '전투시스템', '03', '전투', '투시', '시스', '스템']) FROM documents WHERE doc_id % 3 = 0) SELECT term, count(*) AS n FROM t GROUP BY 1""",
    "query_weights": """WITH t AS (SELECT conv_id, turn, unnest([role, '캐릭터를', '캐릭터', CASE WHEN turn < 10 THEN '0' || turn ELSE turn::VARCHAR END]) AS term, 1.0::DOUBLE AS weight FROM conversations UNION ALL SELECT conv_id, turn, unnest(['캐릭', '릭터']), 0.3::DOUBLE FROM conversations) SELECT DISTINCT * FROM t WHERE term IS NOT NULL""",
    "text_segments": """SELECT doc_id, unnest([0, 1, 2, 3])::INT AS pos, unnest(['text', 'link', 'link', 'text']) AS kind, unnest(['see ', lang, source, ' [x]']) AS value FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""",
    "incremental_index": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text[1:60] ELSE text END AS x FROM documents WHERE doc_id % 7 <> 0), t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM d), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY 1""",
    "embedding_run": """WITH p AS (SELECT doc_id, coalesce(n_chars, 0) AS size FROM documents WHERE doc_id % 6 <> 0 ORDER BY doc_id LIMIT 150), r AS (SELECT doc_id, ((sum(size) OVER (ORDER BY doc_id) - size) // 50000)::BIGINT AS batch FROM p) SELECT * FROM r WHERE batch < 22""",
    "bundle_reuse": f"""WITH {_V}, o AS (SELECT DISTINCT path, CASE WHEN n % 4 = 0 THEN 'old' ELSE source END AS etag FROM v WHERE path IS NOT NULL AND NOT starts_with(path, '_personal')), w AS (SELECT DISTINCT path, source AS etag FROM v WHERE path IS NOT NULL)
        SELECT path, etag, EXISTS (SELECT 1 FROM o WHERE o.path = w.path AND o.etag = w.etag) AS reused FROM w""",
    "people_seen": """WITH e AS (SELECT user_id AS sub, floor(epoch(ts))::BIGINT AS t, event_id % 2 AS odd FROM events), g AS (SELECT sub, min(t) AS first, max(CASE WHEN odd = 0 THEN t END) AS a, max(CASE WHEN odd = 1 THEN t END) AS b FROM e GROUP BY 1)
        SELECT sub, first, CASE WHEN a IS NULL OR b - a >= 3600 THEN b ELSE a END AS last FROM g""",
    "keyword_store": """WITH e AS (SELECT event_type AS keyword, CASE WHEN event_id % 2 = 0 THEN 'hub' || event_id % 9 END AS hub, event_id < 100 AS old FROM events)
        SELECT keyword, coalesce(max(hub) FILTER (NOT old), min(hub) FILTER (old)) AS hub, count(*) AS hits FROM e GROUP BY 1""",
    "insight_hubs": f"WITH {_GRAPH} SELECT dst AS node, sum(refs)::BIGINT AS refs FROM edges GROUP BY 1 HAVING sum(refs) >= 3 ORDER BY refs DESC, node LIMIT 12",
    "insight_loose": f"WITH {_GRAPH}, e AS (SELECT src, dst FROM edges WHERE ends_with(dst, '1')) SELECT id AS doc_id FROM own WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e) ORDER BY id LIMIT 20",
    "insight_gaps": f"WITH {_GRAPH} SELECT target, count(DISTINCT referrer) AS refs FROM ghosts GROUP BY 1 HAVING count(DISTINCT referrer) >= 2 ORDER BY refs DESC, target LIMIT 12",
    "strongest_edges": "WITH e AS (SELECT o_custkey AS src, o_orderpriority AS dst, count(*) AS refs FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY refs DESC) AS n FROM e) SELECT src, dst, refs FROM e WHERE refs >= (SELECT refs FROM r WHERE n = (SELECT ceil(count(*) * 0.1) FROM e))",
    "fused_ranks": f"""WITH {_V}, s AS (SELECT doc_id, n_chars::DOUBLE AS s FROM documents WHERE lang = 'fr'), w AS (SELECT doc_id, sqrt(n_chars) AS w FROM documents),
        x AS (SELECT v.n AS doc_id, s, coalesce(s, 0) / (SELECT max(s) FROM s) * 0.6::DOUBLE + w / (SELECT max(w) FROM w) * 0.4::DOUBLE AS f, coalesce(status = 'outdated', false) OR coalesce(starts_with(folder, 'Archive/'), false) AS old, n % 6 AS g, source FROM v LEFT JOIN s ON s.doc_id = n JOIN w ON w.doc_id = n)
        SELECT doc_id, round(f * CASE WHEN s IS NULL AND old THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN g = 1 THEN 0.15::DOUBLE ELSE 1 END * CASE WHEN source = 'src3' THEN 1.1::DOUBLE ELSE 1 END, 9) AS score FROM x WHERE f > 0 AND (s IS NOT NULL OR g <> 0)""",
    "relative_hits": "SELECT doc_id FROM documents WHERE n_chars >= 7000 AND n_chars >= (SELECT max(n_chars) FROM documents) * 0.6",
    "small_vault": "SELECT doc_id, CASE WHEN lang = 'fr' THEN n_chars ELSE 0 END::DOUBLE AS score, 'small' AS vault FROM documents WHERE doc_id < 5 UNION ALL SELECT doc_id, n_chars::DOUBLE, 'large' FROM documents WHERE lang = 'fr'",
    "open_proposals": f"WITH {_GRAPH} SELECT src AS proposal, string_agg(dst, ';' ORDER BY dst) AS targets FROM edges WHERE ends_with(src, '3') AND starts_with(dst, 'fr') GROUP BY 1",
    "batch_dates": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "matching_notes": f"WITH {_V} SELECT n FROM v WHERE starts_with(source, 'src1') UNION ALL SELECT n FROM v WHERE lang = 'fr' UNION ALL SELECT n FROM v WHERE starts_with(filename, 'n12')",
}
