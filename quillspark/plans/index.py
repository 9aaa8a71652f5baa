"""Index segments and folded sections over the documents, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import markdown
from quillspark.operators import folding, index, rewrite
from quillspark.session import new_folder, table
from quillspark.sources import segments

#: Names and what they link to: a longer one first, one that is a part of it, one with marks, one that isn't there.
NAMES = [("of the", "Of"), ("the", "The"), ("thing", "thing"), ("de la", "Delta"), ("enheit", "Einheit"), ("of", "Of"), ("no such name", "none"), ("###", "Mark")]
LOOKED_UP = ["de", "enheit", "of", "que", "the", "then", "thing", "zu"]
#: A document's lines as paragraphs; every fourth opens a section.
LAID_OUT = "array_join(transform(split(coalesce(text, ''), '\\n'), (l, i) -> CASE WHEN i % 4 = 3 THEN concat('## part ', CAST(i AS STRING), '\\n', l) ELSE l END), '\\n\\n')"


def _segments(spark, d) -> str:
    """Documents indexed at first (but every seventh), then changed (every fifth, to its first 60 characters), then added (every seventh) and deleted (every eleventh)."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    folder = new_folder(spark, "segments")
    segments.create(index.postings(docs.where("doc_id % 7 <> 0")), folder)
    changed = docs.where("doc_id % 7 <> 0 AND doc_id % 5 = 0").withColumn("text", F.substring("text", 1, 60))
    segments.append(index.postings(changed), changed, folder, 1)
    segments.append(index.postings(docs.where("doc_id % 7 = 0 AND doc_id % 11 <> 0")), docs.where("doc_id % 11 = 0"), folder, 2)
    return folder


def _statistics(found):
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def segment_lookup(spark, d):
    """Statistics of searched terms over a base and two segments."""
    return _statistics(segments.postings(spark, _segments(spark, d), LOOKED_UP))


def compacted_index(spark, d):
    """Statistics of all terms from b to below t after the segments have become one."""
    folder = _segments(spark, d)
    segments.compact(spark, folder)
    return _statistics(segments.postings(spark, folder, least="b", below="t"))


def folded_sections(spark, d):
    """Sections of the documents' whole texts, merged under 300 characters and parted over 2000."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.expr(LAID_OUT).alias("body"))
    found = folding.folded(markdown.sections(docs))
    return found.select("doc_id", "section_id", "heading", F.length("body").cast("long").alias("n"), F.md5("body").alias("digest"))


def title_mentions(spark, d):
    """The documents' whole texts with the first mention of each name linked: words of the searched kind, pairs of them, and every supplier's and part's name."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    stated = spark.createDataFrame([(n, t) for n, t in NAMES], "name string, target string")
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("target"))
    suppliers = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_name").alias("target"))
    found = rewrite.link_mentions(docs, stated.unionByName(parts).unionByName(suppliers))
    return found.select("doc_id", F.length("body").cast("long").alias("n"), F.md5("body").alias("digest"))


QUERIES = {f.__name__: f for f in (segment_lookup, compacted_index, folded_sections, title_mentions)}

_FINAL = "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN text[1:60] ELSE text END AS text FROM documents WHERE doc_id IS NOT NULL AND doc_id % 11 <> 0"


def segment_oracle(tokens: str, where: str) -> str:
    """tokens: SQL of a text's tokens."""
    return f"WITH f AS ({_FINAL}), t AS (SELECT doc_id, unnest({tokens}) AS term FROM f), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p WHERE {where} GROUP BY 1"


def oracles(tokens: str) -> dict[str, str]:
    looked = ", ".join(f"'{t}'" for t in LOOKED_UP)
    trim = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    nn = "chr(10) || chr(10)"
    return {
        "segment_lookup": segment_oracle(tokens, f"term IN ({looked})"),
        "compacted_index": segment_oracle(tokens, "term >= 'b' AND term < 't'"),
        # Three folds as recursions: merge forward, merge the tail, part at blank lines.
        "folded_sections": f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents WHERE doc_id IS NOT NULL),
 g AS (SELECT doc_id, (i + 1) // 4 AS g, string_agg(line, {nn} ORDER BY i) AS body FROM l GROUP BY 1, 2),
 s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS n, CASE WHEN g = 0 THEN '(intro)' ELSE 'part ' || (4 * g - 1) END AS heading, doc_id || '_' || CASE WHEN g = 0 THEN 'intro' ELSE 'part_' || (4 * g - 1) END AS id, {trim("body")} AS body FROM g WHERE g > 0 OR trim(body, ' ') <> ''),
 r AS (SELECT doc_id, n, 1::BIGINT AS g, id, heading, body FROM s WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN small THEN g ELSE g + 1 END, CASE WHEN small AND old_heading <> '(intro)' THEN old_id ELSE id END, CASE WHEN small AND old_heading <> '(intro)' THEN old_heading ELSE heading END,
   CASE WHEN small THEN {trim(f"old_body || {nn} || CASE WHEN heading = '(intro)' THEN '' ELSE '## ' || heading || chr(10) END || body")} ELSE body END
   FROM (SELECT s.*, r.g, r.id AS old_id, r.heading AS old_heading, r.body AS old_body, length(r.body) < 300 AS small FROM r JOIN s ON s.doc_id = r.doc_id AND s.n = r.n + 1)),
 m AS (SELECT doc_id, g, id, heading, body, max(g) OVER (PARTITION BY doc_id) AS most FROM r QUALIFY n = max(n) OVER (PARTITION BY doc_id, g)),
 z AS (SELECT a.doc_id, a.g, a.id, a.heading, CASE WHEN b.doc_id IS NULL THEN a.body ELSE {trim(f"a.body || {nn} || CASE WHEN b.heading = '(intro)' THEN '' ELSE '## ' || b.heading || chr(10) END || b.body")} END AS body
  FROM m a LEFT JOIN m b ON b.doc_id = a.doc_id AND b.g = a.g + 1 AND b.g = b.most AND length(b.body) < 300 WHERE NOT (a.g = a.most AND a.g > 1 AND length(a.body) < 300)),
 q AS (SELECT doc_id, g, id, heading, list_filter(string_split_regex(body, '\\n\\s*\\n+'), lambda p: {trim("p")} <> '') AS ps FROM z WHERE length(body) > 2000),
 w AS (SELECT doc_id, g, id, heading, ps, 0::BIGINT AS i, 0::BIGINT AS k, '' AS buf, NULL::VARCHAR AS done FROM q
  UNION ALL SELECT doc_id, g, id, heading, ps, i + 1, CASE WHEN f THEN k + 1 ELSE k END, CASE WHEN f OR buf = '' THEN ps[i + 1] ELSE buf || {nn} || ps[i + 1] END, CASE WHEN f THEN {trim("buf")} END
   FROM (SELECT *, length(buf) + length(ps[i + 1]) + 2 > 2000 AND buf <> '' AS f FROM w WHERE i < len(ps))),
 t AS (SELECT doc_id, g, id, heading, k, {trim("buf")} AS tail FROM w WHERE i = len(ps)),
 a AS (SELECT doc_id, g, id, heading, k - 1 AS k, done AS body FROM w WHERE done IS NOT NULL),
 o AS (SELECT doc_id, id, heading, 0::BIGINT AS k, body FROM z WHERE length(body) <= 2000
  UNION ALL SELECT a.doc_id, a.id, a.heading, a.k, CASE WHEN t.doc_id IS NULL THEN a.body ELSE a.body || {nn} || t.tail END FROM a LEFT JOIN t ON t.doc_id = a.doc_id AND t.g = a.g AND t.k = a.k + 1 AND t.tail <> '' AND length(t.tail) < 300
  UNION ALL SELECT doc_id, id, heading, k, tail FROM t WHERE tail <> '' AND NOT (k > 0 AND length(tail) < 300))
 SELECT doc_id, id || CASE WHEN k > 0 THEN '_part' || (k + 1) ELSE '' END AS section_id, heading || CASE WHEN k > 0 THEN ' (part ' || (k + 1) || ')' ELSE '' END AS heading, length(body) AS n, md5(body) AS digest FROM o""",
    }
