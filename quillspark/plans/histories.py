"""Versions, chains, memberships and near vectors over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import graph, history, index, lint, nearest
from quillspark.session import table

#: A later version of a document: every fifth line gone, every seventh changed, one more after every ninth.
LATER = "array_join(flatten(transform(split(coalesce(text, ''), '\\n'), (l, i) -> CASE WHEN i % 5 = 4 THEN array() WHEN i % 7 = 6 THEN array(concat(l, '!')) WHEN i % 9 = 8 THEN array(l, 'one more') ELSE array(l) END)), '\\n')"


def version_diffs(spark, d):
    """Whole documents against a later version of them."""
    pairs = table(spark, d, "documents").select("doc_id", F.col("text").alias("before"), F.expr(LATER).alias("after"))
    return history.diffs(pairs).select("doc_id", "added", "removed", "unchanged", F.md5("diff").alias("digest"))


def relay_chains(spark, d):
    """A customer's orders as tasks that are handed on within a year; a longer pause starts a new chain."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o.withColumns({"_before": F.lag("o_orderkey").over(by), "_pause": F.datediff("o_orderdate", F.lag("o_orderdate").over(by))})
    return history.chains(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("_pause") <= 365, F.col("_before")).alias("previous")))


def similar_members(spark, d):
    """Each document with the one that stands for all with equal term counts (`similar_documents` has the links between these)."""
    return graph.copies(index.postings(table(spark, d, "documents").where("doc_id is not null")))


def near_vectors(spark, d):
    """About the ten nearest vectors of every vector whose id is divisible by 50, over all vectors (recall against `vector_topk` is tested)."""
    v = table(spark, d, "embeddings")
    return nearest.search(v, v.where("vec_id % 50 = 0"), 10)


def _met(spark, d):
    """Suppliers that met in an order's largest lines (quantity 49 and more): the first and the last of an order are linked."""
    large = table(spark, d, "lineitem").where("l_quantity >= 49").groupBy("l_orderkey")
    return large.agg(F.min("l_suppkey").alias("src"), F.max("l_suppkey").alias("dst")).where("src <> dst").select("src", "dst")


def cut_suppliers(spark, d):
    """Suppliers without which others lose each other, and how many nodes but for the largest piece are then cut off."""
    return graph.cut_points(_met(spark, d)).select("node", F.col("stranded").cast("long").alias("stranded"))


def lint_single_points(spark, d):
    """The same as findings: an error where three nodes or more would be cut off."""
    return lint.cut_spof(_met(spark, d)).select("rule", "severity", "doc_id", "score")


QUERIES = {f.__name__: f for f in (version_diffs, relay_chains, similar_members, near_vectors, cut_suppliers, lint_single_points)}

#: Every node is taken out in turn: what its neighbours still reach from each other is a piece.
_CUTS = """WITH RECURSIVE m AS (SELECT min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem WHERE l_quantity >= 49 GROUP BY l_orderkey HAVING min(l_suppkey) <> max(l_suppkey)),
 e AS (SELECT a AS u, b AS v FROM m UNION SELECT b, a FROM m), r(gone, start, node) AS (SELECT u, v, v FROM e UNION SELECT gone, start, e.v FROM r JOIN e ON e.u = r.node WHERE e.v <> r.gone),
 p AS (SELECT gone, min(start) AS piece, node FROM r GROUP BY gone, node), s AS (SELECT gone, piece, count(*) AS n FROM p GROUP BY 1, 2),
 c AS (SELECT gone AS node, (sum(n) - max(n))::BIGINT AS stranded FROM s GROUP BY 1 HAVING count(*) > 1)"""


def oracles(tokens: str) -> dict[str, str]:
    return {
        "relay_chains": """WITH RECURSIVE p AS (SELECT o_orderkey AS id, CASE WHEN datediff('day', lag(o_orderdate) OVER w, o_orderdate) <= 365 THEN lag(o_orderkey) OVER w END AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 r AS (SELECT id, id AS head, 0::BIGINT AS place FROM p WHERE previous IS NULL UNION ALL SELECT p.id, head, place + 1 FROM r JOIN p ON p.previous = r.id)
 SELECT r.id, head, first_value(r.id) OVER (PARTITION BY head ORDER BY place DESC) AS tail, place, count(*) OVER (PARTITION BY head) AS n, x.id AS next FROM r LEFT JOIN p x ON x.previous = r.id""",
        "cut_suppliers": f"{_CUTS} SELECT node, stranded FROM c",
        "lint_single_points": f"{_CUTS} SELECT 'bridge-spof' AS rule, CASE WHEN stranded >= 3 THEN 'error' ELSE 'warn' END AS severity, node AS doc_id, stranded::DOUBLE AS score FROM c WHERE stranded > 0",
        "similar_members": f"""WITH t AS (SELECT doc_id, unnest({tokens}) AS term FROM documents WHERE doc_id IS NOT NULL), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), m AS (SELECT doc_id, list(term || ' ' || tf ORDER BY term) AS bag FROM p GROUP BY 1)
 SELECT doc_id, min(doc_id) OVER (PARTITION BY bag) AS representative FROM m""",
    }
