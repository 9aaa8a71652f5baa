"""Fielded, concept-grouped and boosted ranking over the documents, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import paths
from quillspark.functions import text as T
from quillspark.operators import ranking as R
from quillspark.operators import synonyms, terms
from quillspark.plans.vault import LAYOUT
from quillspark.session import cut, table

#: What is searched for, a table of synonyms as an editor would state it, and what a corpus might add.
SEARCHES = [(1, "thing then de enheit"), (2, "than of the erth"), (3, "que 12 05 la")]
STATIC = [("thing", "in"), ("in", "is"), ("de", "la"), ("la", "les"), ("enheit", "und"), ("then", "than"), ("of", "on")]
MINED = [("then", "thou"), ("thou", "the"), ("que", "tion")]
PERSONA, WANTED_TAGS, CONTEXT = "src3", ["fr", "de"], ["eaueau", "schein", "other"]
K = 10
VIEW = {
    "doc_id": "doc_id",
    "title": "split_part(coalesce(text, ''), chr(10), 1)",
    **{k: LAYOUT[k] for k in ("folder", "lang", "source", "status", "mtime", "deleted")},
    "body": "coalesce(text, '')",
    "kind": "CASE doc_id % 4 WHEN 0 THEN 'Spec' WHEN 1 THEN 'note' END",
}


def view(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id is not null").selectExpr(*[f"{v} AS {k}" for k, v in VIEW.items()])


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id long, text string")


def _pairs(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "term string, synonym string")


def _words(terms_: DataFrame) -> list[str]:
    """The searches' terms: a handful, as people type them."""
    return sorted({r["term"] for r in terms_.select("term").distinct().collect()})


def _age(docs: DataFrame):
    """Days before the newest document."""
    return (F.lit(docs.agg(F.max("mtime")).first()[0]) - F.col("mtime")) / 86_400_000.0


def bm25_fields_topk(spark, d):
    """Titles count twice, beside tags and text; deleted documents are in the statistics, not in the result."""
    docs = view(spark, d)
    asked = R.flat_terms(searches(spark).select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")))
    hits = R.field_hits(docs, {"title": (F.col("title"), 2), "tags": (F.col("lang"), 1), "text": (F.col("body"), 1)}, _words(asked), ["deleted"])
    found = R.scored(hits, asked, R.Scoring(cap=255), factor=F.when(F.col("deleted"), 0.0).otherwise(1.0)).where("score > 0")
    return R.best(found, K).select("query_id", "rank", "doc_id", "score")


def bm25_names_topk(spark, d):
    """A term of the name gives 1.5 times as much; synonyms are terms of their own; new documents gain, proposals lose."""
    docs = view(spark, d)
    base = searches(spark).select("query_id", F.explode(R.stems(F.col("text"))).alias("term"))
    asked = R.flat_terms(base, _pairs(spark, STATIC), _pairs(spark, MINED))
    fields = {"name": (F.col("title"), 1), "tags": (F.col("lang"), 1), "speaker": (F.col("source"), 1), "text": (F.col("body"), 2)}
    hits = R.field_hits(docs, fields, _words(asked), ["mtime", "folder"], F.col("title"), R.stems)
    p = R.Scoring(b=0.55, name_boost=1.5, coverage=True, recency=0.1)
    found = R.scored(hits, asked, p, _age(docs), F.when(F.col("folder").startswith("_agent"), 0.5).otherwise(1.0))
    return R.best(found, K).select("query_id", "rank", "doc_id", "score")


def _concepts(spark, d, docs: DataFrame) -> DataFrame:
    asked = R.concept_terms(searches(spark), _pairs(spark, STATIC), _pairs(spark, MINED))
    fields = {k: (F.col(c), 1) for k, c in (("name", "title"), ("source", "source"), ("tags", "lang"), ("text", "body"))}
    hits = R.field_hits(docs, fields, _words(asked), ["mtime"], None, R.stems)
    return R.scored(hits, asked, R.Scoring(coverage=True, present=True, recency=0.1, concept_cap=2.0, absolute=True), _age(docs))


def bm25_concepts_topk(spark, d):
    """A query's words are concepts with their synonyms; a concept gives at most twice its cap; scores are absolute, up to 1."""
    return R.best(_concepts(spark, d, view(spark, d)), K).select("query_id", "rank", "doc_id", "score", "matched")


def _boosted(spark, d) -> DataFrame:
    docs = view(spark, d)
    found = R.best(_concepts(spark, d, docs), 2 * K)
    wanted = F.array(*[F.lit(t) for t in WANTED_TAGS])
    # The hits are 2 K rows a search; stems of a search are a few.
    stems = searches(spark).select("query_id", F.array_distinct(T.primary_stems(F.col("text"))).alias("stems"))
    rows = found.select("query_id", "doc_id", "score").join(docs, "doc_id").join(F.broadcast(stems), "query_id")
    status, outdated = paths.status_boost(F.col("status")), paths.outdated(F.col("status"), F.col("folder"))
    tags = R.shared_tags(F.array("lang"), wanted)
    score = R.boosted(F.col("score"), F.col("source") == PERSONA, tags, status, F.col("folder").startswith("_agent"), outdated, R.share_of(F.col("body"), CONTEXT))
    out = rows.withColumns({"score": score, "passage": R.passage(F.split("body", "\n"), F.col("stems")), "tag_boost": tags, "status_boost": status, "outdated": outdated})
    return R.best(out, K)


def boosted_topk(spark, d):
    """Hits after what speaks for a document, each with its best line."""
    return _boosted(spark, d).select("query_id", "rank", "doc_id", "score", F.col("passage.pos").cast("long").alias("line"))


def reranked_topk(spark, d):
    """The boosted hits once more, by the words of the shown passage (400 characters of the best line)."""
    rows = _boosted(spark, d)
    shown = F.lower(F.substring("passage.text", 1, 400))
    overlap = F.coalesce(F.size(F.filter("stems", lambda t: F.contains(shown, t))) / F.size("stems"), F.lit(0.0))
    score = R.reranked(F.col("score"), overlap, F.col("source") == PERSONA, F.col("lang") == "de", F.col("tag_boost"), F.coalesce("kind", F.lit("")), F.col("status_boost"), F.col("outdated"))
    return R.best(rows.withColumn("score", score), K).select("query_id", "rank", "doc_id", "score")


def expanded_turns(spark, d):
    """What synonyms (stated, and mined from the documents' lines) and days add to each turn's terms."""
    # Mined pairs and turns' terms are read more than once, so each is computed once.
    mined = cut(terms.synonyms(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("text"))).select("term", "synonym"))
    turns = cut(table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(T.primary_stems(F.col("text")))).alias("term")))
    wide = synonyms.expanded(turns, ["conv_id", "turn"], _pairs(spark, STATIC), mined)
    return wide.join(turns, ["conv_id", "turn", "term"], "left_anti").select("conv_id", "turn", "term")


QUERIES = {f.__name__: f for f in (bm25_fields_topk, bm25_names_topk, bm25_concepts_topk, boosted_topk, reranked_topk, expanded_turns)}


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda x: length(x) > 1)"


def _stem(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[\\s,.\\-_?!;:()\\[\\]{{}}''\"《》「」【】]+'), lambda x: length(x) > 1)"


_VIEW = f"v AS (SELECT {', '.join(f'{x} AS {k}' for k, x in VIEW.items())} FROM documents WHERE doc_id IS NOT NULL)"
_ASKED = f"s AS (SELECT query_id::BIGINT AS query_id, text FROM {_values(SEARCHES)} t(query_id, text))"
_STATIC = f"st(term, synonym) AS (SELECT * FROM {_values(STATIC)})"
_MINED = f"mi(term, synonym) AS (SELECT * FROM {_values(MINED)})"


def _postings(fields: list[tuple[str, int]], tok) -> str:
    """p: doc_id, term, tf; len: doc_id, dl; g: n, avgdl."""
    union = " UNION ALL ".join(f"SELECT doc_id, unnest({tok(c)}) AS term, {w} AS w FROM v" for c, w in fields)
    length = " + ".join(f"{w} * len({tok(c)})" for c, w in fields)
    return f"dl AS (SELECT doc_id, ({length}) AS dl FROM v), g AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), p AS (SELECT doc_id, term, sum(w)::BIGINT AS tf FROM ({union}) GROUP BY 1, 2)"


_IDF = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
#: Terms with their synonyms, of a table b (key columns k, term).
_WIDE = """{to} AS (WITH o AS (SELECT DISTINCT {k}, term FROM {b}), h AS (SELECT DISTINCT {k}, y.synonym AS term FROM o JOIN (SELECT * FROM st UNION SELECT * FROM mi) y USING (term) EXCEPT SELECT {k}, term FROM o)
 SELECT {k}, term FROM o UNION SELECT {k}, term FROM h UNION SELECT {k}, st.synonym FROM h JOIN st USING (term)
 UNION SELECT {k}, m.term || d.term FROM o AS m JOIN o AS d USING ({k}) WHERE m.term <> d.term AND regexp_full_match(m.term, '0[1-9]|1[0-2]') AND regexp_full_match(d.term, '0[1-9]|[12][0-9]|3[01]'))"""
_AGE = "exp(-((SELECT max(mtime) FROM v) - mtime) / 86400000.0::DOUBLE / 180)"
_TOP = "round(score, 6) AS score FROM {t} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= {k}"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank"
_CONCEPTS = f"""{_VIEW}, {_ASKED}, {_STATIC}, {_MINED}, {_postings([("title", 1), ("source", 1), ("lang", 1), ("body", 1)], _stem)},
 b AS (SELECT query_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT query_id, list_distinct(t) AS t FROM (SELECT query_id, {_stem("text")} AS t FROM s))),
 bp AS (SELECT query_id * 100 + pos AS qp, term FROM b), {_WIDE.format(to="ex", k="qp", b="bp")}, {_WIDE.format(to="al", k="query_id", b="b")},
 ow AS (SELECT qp // 100 AS query_id, term, min(qp % 100) AS concept FROM ex GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 q AS (SELECT al.query_id, al.term, concept, {_IDF} AS idf FROM al LEFT JOIN ow USING (query_id, term) JOIN df USING (term), g),
 ca AS (SELECT query_id, concept, max(idf) * 2.5 AS cap FROM q WHERE concept IS NOT NULL GROUP BY 1, 2),
 de AS (SELECT query_id, (coalesce((SELECT sum(cap) FROM ca WHERE ca.query_id = q.query_id), 0) + coalesce(sum(idf) FILTER (concept IS NULL), 0) * 2.5) * 1.1 AS den, count(DISTINCT concept) AS asked FROM q GROUP BY 1),
 pa AS (SELECT query_id, doc_id, concept, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM p JOIN q USING (term) JOIN dl USING (doc_id), g GROUP BY 1, 2, 3),
 fo AS (SELECT query_id, doc_id, sum(least(s, coalesce(2 * cap, s))) AS s, count(concept) AS matched FROM pa LEFT JOIN ca USING (query_id, concept) GROUP BY 1, 2),
 sc AS (SELECT query_id, doc_id, matched, least(1.0, s * CASE WHEN asked > 1 THEN sqrt(matched::DOUBLE / asked) ELSE 1 END * (1 + 0.1 * {_AGE}) / den)::DOUBLE AS score FROM fo JOIN de USING (query_id) JOIN v USING (doc_id))"""
_OPEN = "lower(trim(coalesce(status, ''))) IN (" + ", ".join(f"'{x}'" for x in paths.OPEN) + ")"
_CLOSED = "lower(trim(coalesce(status, ''))) IN (" + ", ".join(f"'{x}'" for x in paths.CLOSED if "'" not in x) + ")"
_TAGS = f"CASE WHEN lower(lang) IN ({', '.join(repr(t) for t in WANTED_TAGS)}) THEN 0.1::DOUBLE ELSE 0 END"
_STATUS = f"CASE WHEN {_OPEN} THEN 0.05::DOUBLE WHEN {_CLOSED} THEN -0.05::DOUBLE ELSE 0 END"
_OLD = "(coalesce(status, '') IN ('outdated', 'deprecated') OR regexp_matches(lower(folder) || '/', '(^|/)[.]?archive/'))"
_CTX = "(" + " + ".join(f"contains(lower(body), '{t}')::INT" for t in CONTEXT) + f") / {len(CONTEXT)}.0::DOUBLE"
_BOOSTED = f"""{_CONCEPTS}, hit AS (SELECT query_id, doc_id, {_TOP.format(t="sc", k=2 * K)}),
 bo AS (SELECT hit.* EXCLUDE (score), v.* EXCLUDE (doc_id), greatest(0.0, least(1.0, score * (1 + CASE WHEN source = '{PERSONA}' THEN 0.1::DOUBLE ELSE 0 END + {_TAGS} + {_STATUS}) * CASE WHEN starts_with(folder, '_agent') THEN 0.5::DOUBLE ELSE 1 END
  - CASE WHEN {_OLD} THEN 0.25::DOUBLE ELSE 0 END + 0.3::DOUBLE * ({_CTX})))::DOUBLE AS score, string_split(body, chr(10)) AS lines, (SELECT list_distinct({_stem("text")}) FROM s WHERE s.query_id = hit.query_id) AS stems FROM hit JOIN v USING (doc_id)),
 ln AS (SELECT *, list_filter(list_transform(range(len(lines)), lambda i: {{'h': len(list_filter(stems, lambda t: contains(lower(lines[i + 1]), t))), 'b': -i, 't': lines[i + 1]}}), lambda x: trim(x.t, ' ') <> '') AS found FROM bo),
 bk AS (SELECT *, list_sort(found, 'DESC', 'NULLS LAST')[1] AS m, {_RANK} FROM ln QUALIFY rank <= {K})"""

ORACLES = {
    "bm25_fields_topk": f"""WITH {_VIEW}, {_ASKED}, {_postings([("title", 2), ("lang", 1), ("body", 1)], _tok)}, q AS (SELECT DISTINCT query_id, unnest({_tok("text")}) AS term FROM s),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, sum({_IDF} * least(tf, 255) * 2.5 / (least(tf, 255) + 1.5 * (0.25 + 0.75 * dl / avgdl)))::DOUBLE AS score FROM p JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), g GROUP BY 1, 2)
 SELECT query_id, {_RANK}, doc_id, round(score, 6) AS score FROM sc JOIN v USING (doc_id) WHERE NOT deleted QUALIFY rank <= {K}""",
    "bm25_names_topk": f"""WITH {_VIEW}, {_ASKED}, {_STATIC}, {_MINED}, {_postings([("title", 1), ("lang", 1), ("source", 1), ("body", 2)], _stem)}, b AS (SELECT DISTINCT query_id, unnest({_stem("text")}) AS term FROM s), {_WIDE.format(to="q", k="query_id", b="b")},
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), na AS (SELECT DISTINCT doc_id, unnest({_stem("title")}) AS term, 1.5::DOUBLE AS boost FROM v),
 w AS (SELECT query_id, doc_id, count(*) AS matched, sum({_IDF} * tf * 2.5 / (tf + 1.5 * (0.45 + 0.55 * dl / avgdl)) * coalesce(boost, 1))::DOUBLE AS s FROM p JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id) LEFT JOIN na USING (doc_id, term), g GROUP BY 1, 2),
 sc AS (SELECT query_id, doc_id, s * sqrt(matched::DOUBLE / (SELECT count(*) FROM q WHERE q.query_id = w.query_id)) * (1 + 0.1 * {_AGE}) * CASE WHEN starts_with(folder, '_agent') THEN 0.5 ELSE 1 END AS score FROM w JOIN v USING (doc_id))
 SELECT query_id, {_RANK}, doc_id, round(score, 6) AS score FROM sc QUALIFY rank <= {K}""",
    "bm25_concepts_topk": f"WITH {_CONCEPTS} SELECT query_id, {_RANK}, doc_id, round(score, 6) AS score, matched FROM sc QUALIFY rank <= {K}",
    "boosted_topk": f"WITH {_BOOSTED} SELECT query_id, rank, doc_id, round(score, 6) AS score, (-m.b)::BIGINT AS line FROM bk",
    "reranked_topk": f"""WITH {_BOOSTED}, rr AS (SELECT query_id, doc_id, (0.6::DOUBLE * round(score, 6) + 0.3::DOUBLE * coalesce(len(list_filter(stems, lambda t: contains(lower(m.t[1:400]), t)))::DOUBLE / len(stems), 0)) *
  (1 + CASE WHEN source = '{PERSONA}' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN lang = 'de' THEN 0.15::DOUBLE ELSE 0 END + {_TAGS} + CASE WHEN lower(kind) IN ('spec', 'guide', 'reference') THEN 0.05::DOUBLE ELSE 0 END + {_STATUS})
  - CASE WHEN {_OLD} THEN 0.3::DOUBLE ELSE 0 END AS score FROM bk)
 SELECT query_id, {_RANK}, doc_id, round(score, 6) AS score FROM rr QUALIFY rank <= {K}""",
}


def expanded_turns_oracle(mined: str) -> str:
    """mined: the SQL of the query `pmi_synonyms`."""
    return f"""WITH {_STATIC}, mi AS MATERIALIZED (SELECT term, synonym FROM ({mined})), tu AS (SELECT conv_id * 1000 + turn AS k, conv_id, turn, {_stem("coalesce(text, '')")} AS t FROM conversations),
 b AS (SELECT DISTINCT k, unnest(t) AS term FROM tu), {_WIDE.format(to="wi", k="k", b="b")}
 SELECT conv_id, turn, term FROM (SELECT k, term FROM wi EXCEPT SELECT k, term FROM b) JOIN tu USING (k)"""
