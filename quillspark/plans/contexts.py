"""Contexts for a question, from the walk, from a document, from hubs and from hits, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import paths
from quillspark.operators import context, graph, index, insights
from quillspark.operators.index import Bm25
from quillspark.plans.vault import LAYOUT
from quillspark.session import cut, table

START, SPEAKER, ITERATIONS = 7, "src3", 10
TERMS = ["thing", "then", "de", "enheit"]
#: Documents as notes: each line a section, the first the introduction.
VIEW = {
    "doc_id": "doc_id",
    "name": "'n' || CAST(doc_id AS STRING)",
    "body": "coalesce(text, '')",
    **{k: LAYOUT[k] for k in ("source", "status", "folder")},
    "day": "CAST(CAST('2023-11-14' AS DATE) + CAST(doc_id AS INT) AS STRING)",
    "graph_weight": "CASE doc_id % 9 WHEN 0 THEN 'skip' WHEN 1 THEN 'low' END",
}
LINKS = "SELECT doc_id AS src, CAST(floor(doc_id / 2) AS BIGINT) AS dst FROM documents UNION SELECT doc_id, doc_id + 3 FROM documents"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("doc_id is not null").selectExpr(*[f"{v} AS {k}" for k, v in VIEW.items()])


def _edges(spark, d) -> DataFrame:
    own = table(spark, d, "documents").where("doc_id is not null").select("doc_id")
    links = own.select(F.col("doc_id").alias("src"), F.explode(F.array(F.floor(F.col("doc_id") / 2), F.col("doc_id") + 3)).alias("dst")).where("src <> dst").distinct()
    return cut(links.join(own.select(F.col("doc_id").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _hits(spark, d, k: int = 5) -> DataFrame:
    return cut(index.top(index.bm25(table(spark, d, "documents").where("doc_id is not null"), TERMS, Bm25(cap=255)), k).select("doc_id", "score"))


def _sections():
    return F.transform(F.split("body", "\n"), lambda line, i: F.struct(F.when(i == 0, "(intro)").otherwise(F.concat(F.lit("part "), i.cast("string"))).alias("heading"), line.alias("body")))


def _out(entries: DataFrame, total: int, lead: int, skip: bool) -> DataFrame:
    found = context.fitted(entries.withColumn("context_id", F.lit(0)), ["context_id"], total, lead, skip)
    return found.select("place", "doc_id", F.length("entry").cast("long").alias("n"), F.md5("entry").alias("digest"))


def _entry(head, text):
    return F.concat(head, F.lit("\n"), text, F.lit("\n\n"))


def walk_context(spark, d):
    """Hits and what a walk from them meets, 14 at most, by search and walk; an entry that doesn't fit is left out alone."""
    docs, hits = _docs(spark, d), _hits(spark, d)
    edges = _edges(spark, d).withColumn("weight", F.lit(1.0))
    walk = graph.personalised(edges, hits.select(F.col("doc_id").alias("node"), "score"), iterations=ITERATIONS).select(F.col("node").alias("doc_id"), "score")
    mixed = insights.fused(hits, walk, docs.select("doc_id", "status", "folder", "graph_weight", F.col("source").alias("speaker")), SPEAKER).withColumn("score", F.round("score", 9))
    best = mixed.orderBy(F.desc("score"), "doc_id").limit(14)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))  # 14 rows
    rows = docs.join(F.broadcast(placed), "doc_id").join(F.broadcast(hits.select(F.col("doc_id").alias("_hit"))), F.col("doc_id") == F.col("_hit"), "left")
    label = F.concat(context.tier_label(F.col("place"), F.col("_hit").isNotNull()), F.lit("|Score "), context.percent(F.col("score")))
    head = context.header(label, F.col("name"), F.col("source"), F.col("day"), None, F.coalesce(F.col("status").isin("outdated", "deprecated"), F.lit(False)))
    text = context.content(F.col("body"), _sections(), F.array(*[F.lit(t) for t in TERMS]), context.tier_budget(F.col("place"), F.length("body")))
    return _out(rows.select("place", "doc_id", _entry(head, text).alias("entry")), 16_000, 20, True)


def _explored(docs: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """The nearest documents, newer ones first, with their place."""
    order = ["hops", F.desc("day"), "doc_id"]
    met = docs.join(found.select(F.col("node").alias("doc_id"), F.col("hops").cast("int").alias("hops")), "doc_id")
    best = met.select("doc_id", "hops", "day").orderBy(*order).limit(most)
    return docs.drop("day").join(F.broadcast(best.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))), "doc_id")


def selected_context(spark, d):
    """What lies up to three links around one document; the first entry that doesn't fit ends it."""
    docs = _docs(spark, d)
    rows = _explored(docs, graph.hops(_edges(spark, d), docs.where(F.col("doc_id") == START).select(F.col("doc_id").alias("node")), 3), 20)
    head = context.header(context.hop_label(F.col("hops")), F.col("name"), F.col("source"), F.col("day"), F.col("folder"))
    text = context.content(F.col("body"), _sections(), None, context.hop_budget(F.col("hops")))
    return _out(rows.select("place", "doc_id", _entry(head, text).alias("entry")), 16_000, 25, False)


def hub_context(spark, d):
    """What lies up to four links around the eight documents with most links."""
    docs, edges = _docs(spark, d), _edges(spark, d)
    hubs = graph.undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(8)
    rows = _explored(docs, graph.hops(edges, hubs.select("node"), 4), 35)
    head = context.header(F.lit("Explored"), F.col("name"), F.col("source"), F.col("day"))
    text = context.content(F.col("body"), _sections(), None, context.hop_budget(F.col("hops")))
    return _out(rows.select("place", "doc_id", _entry(head, text).alias("entry")), 24_000, 28, False)


def compressed_context(spark, d):
    """Five hits' first 300 characters and their neighbours' first 200, as far as 3000 characters reach."""
    docs, hits, edges = _docs(spark, d), _hits(spark, d), _edges(spark, d)
    placed = hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))  # five rows
    near = graph.undirected(edges).join(F.broadcast(hits.select(F.col("doc_id").alias("src"))), "src").select(F.col("dst").alias("doc_id")).distinct().join(hits, "doc_id", "left_anti")
    near = near.orderBy("doc_id").limit(20).withColumn("place", F.row_number().over(Window.orderBy("doc_id")).cast("long"))
    one = docs.join(F.broadcast(placed), "doc_id").select(F.lit(0).alias("k"), "place", F.concat(F.lit("[Document] "), "name", F.lit(" ("), "source", F.lit(")")).alias("header"), F.col("body").alias("content"))
    two = docs.join(F.broadcast(near), "doc_id").select(F.lit(0).alias("k"), "place", F.concat(F.lit("[Connected] "), "name", F.lit(" > (intro)")).alias("header"), F.col("body").alias("content"))
    return context.compressed(one, two, ["k"]).select("role", "place", "header", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


QUERIES = {f.__name__: f for f in (walk_context, selected_context, hub_context, compressed_context)}

_D = f"d AS (SELECT {', '.join(f'{v} AS {k}' for k, v in VIEW.items())} FROM documents WHERE doc_id IS NOT NULL)"
_E = f"e AS (SELECT DISTINCT src, dst FROM ({LINKS}) WHERE src <> dst AND dst IN (SELECT doc_id FROM documents)), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_WS = "regexp_replace({}, '\\s+$', '')"


def _short(c: str, n: str) -> str:
    return f"CASE WHEN length({c}) > {n} THEN {_WS.format(f'substr({c}, 1, {n})')} || '…' ELSE {c} END"


def _reach(start: str, steps: int) -> str:
    return f"z AS (SELECT node, min(hops) AS hops FROM (WITH RECURSIVE h(node, hops) AS (SELECT node, 0 FROM ({start}) UNION SELECT dst, hops + 1 FROM h JOIN b ON src = node WHERE hops < {steps}) SELECT * FROM h) GROUP BY 1)"


_SPEAKER = "coalesce(CASE WHEN source <> '' THEN ' (' || source || ')' END, '')"
_HOP = "CASE hops WHEN 0 THEN 1500 WHEN 1 THEN 900 WHEN 2 THEN 500 ELSE 250 END"
_FIT = "SELECT place, doc_id, length(entry) AS n, md5(entry) AS digest FROM (SELECT *, {lead} + sum(length(entry)) OVER (ORDER BY place) AS used FROM y) WHERE used <= {total}"


def oracles(hits: str) -> dict[str, str]:
    """hits: SQL of the best k hits (doc_id, score), with {k}."""
    steps = []
    for k in range(ITERATIONS):
        steps.append(
            f"p{k + 1} AS MATERIALIZED (SELECT coalesce(f.node, seed.node) AS node, 0.4::DOUBLE * coalesce(p, 0) + 0.6::DOUBLE * coalesce(flow, 0) AS score"
            f" FROM (SELECT dst AS node, sum(score * s) AS flow FROM sh JOIN p{k} ON src = node GROUP BY dst) f FULL JOIN seed ON f.node = seed.node)"
        )
    walk = f"""{_D}, {_E}, hit AS MATERIALIZED ({hits.format(k=5)}), w AS (SELECT src, dst, 1.0::DOUBLE AS w FROM e UNION ALL SELECT dst, src, 1.0::DOUBLE FROM e),
 sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM w), seed AS (SELECT doc_id AS node, greatest(score, 0.01) / (SELECT sum(greatest(score, 0.01)) FROM hit) AS p FROM hit), p0 AS (SELECT node, p AS score FROM seed), {", ".join(steps)},
 fu AS (SELECT d.*, hit.doc_id IS NOT NULL AS seed, 0.6::DOUBLE * coalesce(hit.score, 0) / (SELECT max(score) FROM hit) + 0.4::DOUBLE * coalesce(r.score, 0) / (SELECT max(score) FROM p{ITERATIONS}) AS m FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN p{ITERATIONS} r ON r.node = d.doc_id),
 sc AS (SELECT *, round(m * CASE WHEN NOT seed AND (coalesce(status, '') IN ('outdated', 'deprecated') OR regexp_matches(lower(folder) || '/', '(^|/)[.]?archive/')) THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN graph_weight = 'low' THEN 0.15::DOUBLE ELSE 1 END
  * CASE WHEN source = '{SPEAKER}' THEN 1.1::DOUBLE ELSE 1 END, 9) AS score FROM fu WHERE m > 0 AND (seed OR coalesce(graph_weight, '') <> 'skip')),
 t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, string_split(body, chr(10)) AS lines FROM sc QUALIFY place <= 14),
 u AS (SELECT *, CASE WHEN place <= 3 THEN 1500 WHEN place <= 8 THEN 900 ELSE 500 END AS base, list_sort(list_filter(list_transform(range(len(lines)), lambda i: {{'h': len(list_filter(['{"', '".join(TERMS)}'], lambda t: contains(lower(CASE WHEN i = 0 THEN '(intro) ' || trim(regexp_replace(lines[1], '^#[^\\n]*\\n?', ''), ' ' || chr(9)) ELSE 'part ' || i || ' ' || lines[i + 1] END), t))),
   'b': -i, 't': CASE WHEN i = 0 THEN '' ELSE '### part ' || i || chr(10) END || lines[i + 1]}}), lambda x: regexp_matches(lines[1 - x.b], '\\S')), 'DESC')[1] AS f FROM t),
 v AS (SELECT *, CASE WHEN length(body) > 10000 THEN least(2 * base, greatest(base, floor(length(body) * 0.03::DOUBLE)::INT)) ELSE base END AS budget, CASE WHEN f IS NULL OR f.h <= 0 OR length(f.t) < 200 AND length(body) > 3 * length(f.t) THEN body ELSE f.t END AS text FROM u),
 y AS (SELECT place, doc_id, '[' || CASE WHEN seed OR place <= 3 THEN 'Core' WHEN place <= 8 THEN 'Related' ELSE 'Peripheral' END || '|Score ' || regexp_replace(format('{{:.1f}}', round(score * 100, 1)), '\\.0$', '') || ']' || CASE WHEN coalesce(status, '') IN ('outdated', 'deprecated') THEN ' outdated' ELSE '' END
  || ' ' || name || {_SPEAKER} || ' [' || day || ']' || chr(10) || {_short("text", "budget")} || chr(10) || chr(10) AS entry FROM v),
 g AS (SELECT 0::BIGINT AS place, 20::BIGINT AS used, false AS kept UNION ALL SELECT y.place, CASE WHEN used + length(entry) <= 16000 THEN used + length(entry) ELSE used END, used + length(entry) <= 16000 FROM g JOIN y ON y.place = g.place + 1)"""
    explored = lambda start, steps, most, label, extra: f"""{_D}, {_E}, {_reach(start, steps)}, x AS (SELECT d.*, hops, row_number() OVER (ORDER BY hops, day DESC, doc_id) AS place FROM d JOIN z ON node = doc_id QUALIFY place <= {most}),
 y AS (SELECT place, doc_id, '[' || {label} || '] ' || name || {_SPEAKER} || ' [' || day || ']' || {extra} || chr(10) || {_short("body", f"({_HOP})")} || chr(10) || chr(10) AS entry FROM x)"""  # noqa: E731
    hop = "CASE hops WHEN 0 THEN 'Selected' ELSE hops || '-hop' END"
    return {
        "walk_context": f"WITH RECURSIVE {walk} SELECT y.place, doc_id, length(entry) AS n, md5(entry) AS digest FROM y JOIN g USING (place) WHERE kept",
        "selected_context": f"WITH {explored(f'SELECT {START}::BIGINT AS node', 3, 20, hop, chr(39) + ' [source: ' + chr(39) + ' || folder || ' + chr(39) + ']' + chr(39))} {_FIT.format(lead=25, total=16_000)}".replace(
            "' [source: ' || folder || ']'", "CASE WHEN folder <> '' THEN ' [source: ' || folder || ']' ELSE '' END"
        ),
        "hub_context": f"WITH {explored('SELECT src AS node FROM b GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 8', 4, 35, chr(39) + 'Explored' + chr(39), chr(39) * 2)} {_FIT.format(lead=28, total=24_000)}",
        "compressed_context": f"""WITH RECURSIVE {_D}, {_E}, hit AS MATERIALIZED ({hits.format(k=5)}), n AS (SELECT DISTINCT dst AS doc_id FROM b WHERE src IN (SELECT doc_id FROM hit) AND dst NOT IN (SELECT doc_id FROM hit) ORDER BY 1 LIMIT 20),
 a AS (SELECT 'document' AS role, row_number() OVER (ORDER BY score DESC, doc_id) AS place, '[Document] ' || name || ' (' || source || ')' AS header, body FROM hit JOIN d USING (doc_id)
  UNION ALL SELECT 'connected', row_number() OVER (ORDER BY doc_id), '[Connected] ' || name || ' > (intro)', body FROM n JOIN d USING (doc_id)),
 o AS (SELECT *, row_number() OVER (ORDER BY role DESC, place) AS i FROM a),
 g AS (SELECT 0::BIGINT AS i, 10::BIGINT AS used, ''::VARCHAR AS role, 0::BIGINT AS place, ''::VARCHAR AS header, NULL::VARCHAR AS text, false AS ended, false AS stopped
  UNION ALL SELECT i, CASE WHEN fits THEN used + length(header) + length(text) + 2 ELSE used END, role, place, header, CASE WHEN fits THEN text END, NOT fits, stopped FROM (SELECT *, {_short("body", "most")} AS text, most > 0 AND NOT ended AND NOT stopped AS fits
   FROM (SELECT *, least(CASE WHEN role = 'document' THEN 300 ELSE 200 END, 3000 - used - length(header) - 10) AS most FROM (SELECT o.*, g.used + CASE WHEN turn AND g.used < 2900 THEN 12 ELSE 0 END AS used, CASE WHEN turn THEN false ELSE g.ended END AS ended, CASE WHEN turn THEN g.used >= 2900 ELSE g.stopped END AS stopped
    FROM (SELECT *, false AS unused FROM g) AS g JOIN (SELECT *, role = 'connected' AND place = 1 AS turn FROM o) AS o ON o.i = g.i + 1))))
 SELECT role, place, header, length(text) AS n, md5(text) AS digest FROM g WHERE text IS NOT NULL""",
    }
