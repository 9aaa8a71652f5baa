"""Structural findings over parsed documents: rule, severity, doc_id (or target), score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import graph


@dataclass(frozen=True)
class LintParams:
    """The rules' defaults."""

    phantom_refs: int = 3
    hub_share: float = 0.1
    stale_days: int = 90
    similarity: float = 0.92
    drift: float = 0.6
    drift_size: int = 5
    per_rule: int = 50
    ignored: tuple[str, ...] = ("_reports",)


def _finding(df: DataFrame, rule: str, severity: Column, score: Column, evidence: dict[str, Column] | None = None) -> DataFrame:
    pairs = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v.cast("string"))]
    found = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(rule).alias("rule"), severity.alias("severity"), F.col("doc_id"), score.cast("double").alias("score"), found.cast("map<string,string>").alias("evidence"))


def phantom_hot(phantoms: DataFrame, least: int) -> DataFrame:
    hot = phantoms.groupBy(F.col("target").alias("doc_id")).agg(F.countDistinct("referrer").alias("refs")).where(F.col("refs") >= least)
    return _finding(hot, "phantom-hot", F.lit("error"), F.col("refs"), {"referrers": F.col("refs")})


def cut_spof(edges: DataFrame) -> DataFrame:
    found = graph.cut_points(edges).where("stranded > 0").withColumnRenamed("node", "doc_id")
    return _finding(found, "bridge-spof", F.when(F.col("stranded") >= 3, "error").otherwise("warn"), F.col("stranded"), {"kind": F.lit("cut")})


def thin_spof(edges: DataFrame, membership: DataFrame, cuts: DataFrame) -> DataFrame:
    both = graph.undirected(edges)
    near = both.join(membership.select(F.col("node").alias("dst"), F.col("community").alias("there")), "dst").join(membership.select(F.col("node").alias("src"), F.col("community").alias("here")), "src")
    thin = near.groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("degree"), F.countDistinct(F.when(F.col("there") != F.col("here"), F.col("there"))).alias("others"))
    found = thin.where("degree <= 2 and others > 0").join(cuts.select("doc_id"), "doc_id", "left_anti")
    return _finding(found, "bridge-spof", F.lit("warn"), F.col("others"), {"kind": F.lit("thin")})


def orphans(docs: DataFrame, edges: DataFrame, phantoms: DataFrame) -> DataFrame:
    linked = edges.select(F.col("src").alias("doc_id")).union(edges.select("dst")).distinct()
    broken = phantoms.groupBy(F.col("referrer").alias("doc_id")).agg(F.count("*").alias("unresolved"))
    found = docs.select("doc_id").join(linked, "doc_id", "left_anti").join(broken, "doc_id", "left")
    return _finding(found, "orphan", F.lit("warn"), F.coalesce("unresolved", F.lit(0)))


def stale_hubs(docs: DataFrame, ranks: DataFrame, now_ms: int, p: LintParams) -> DataFrame:
    n = docs.count()
    most = max(3, -(-n * int(p.hub_share * 100) // 100))
    hubs = ranks.orderBy(F.desc("score"), "node").limit(most).select(F.col("node").alias("doc_id"))
    age = F.floor((F.lit(now_ms) - F.col("mtime")) / 86_400_000)
    found = docs.join(hubs, "doc_id").where(F.col("mtime") != 0).select("doc_id", age.alias("age")).where(F.col("age") >= p.stale_days)
    return _finding(found, "stale-hub", F.lit("warn"), F.col("age"))


def near_duplicates(pairs: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """pairs: a, b, similarity; linked pairs and the second of a pair given both ways are left out."""
    one = pairs.where(F.col("similarity") >= least).groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("similarity").alias("similarity"))
    found = one.join(graph.undirected(edges), ["src", "dst"], "left_anti").withColumnRenamed("src", "doc_id")
    return _finding(found, "near-duplicate", F.lit("warn"), F.col("similarity"), {"other": F.col("dst")})


def cluster_drift(before: DataFrame, now: DataFrame, p: LintParams) -> DataFrame:
    """before, now: node, community. Finds earlier communities whose best Jaccard with one of now is low."""
    live = before.join(now.select("node"), "node", "left_semi")
    old, new = (x.groupBy(F.col("community").alias(c)).agg(F.count("*").alias(f"n_{c}")) for x, c in ((live, "old"), (now, "new")))
    both = live.select("node", F.col("community").alias("old")).join(now.select("node", F.col("community").alias("new")), "node").groupBy("old", "new").agg(F.count("*").alias("shared"))
    scored = both.join(old, "old").join(new, "new").withColumn("j", F.col("shared") / (F.col("n_old") + F.col("n_new") - F.col("shared")))
    best = scored.groupBy(F.col("old").alias("doc_id")).agg(F.max("j").alias("best"), F.first("n_old").alias("size"))
    found = best.where((F.col("size") >= p.drift_size) & (F.col("best") < p.drift))
    return _finding(found, "cluster-drift", F.lit("warn"), 1 - F.col("best"), {"previous": F.col("size")})


def run(docs: DataFrame, now_ms: int, p: LintParams = LintParams(), pairs: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """All findings, at most per_rule of a rule, errors first, then by score. Ignored folders leave the graph itself."""
    docs = docs.where(~F.regexp_extract("path", "^([^/]*)/", 1).isin(*p.ignored))
    edges, phantoms = graph.link_graph(docs)
    weighted = graph.undirected(edges).where("src < dst").join(edges.select("src", "dst", F.col("refs").alias("r1")), ["src", "dst"], "left").join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("refs").alias("r2")), ["src", "dst"], "left")
    weighted = weighted.select("src", "dst", (F.coalesce("r1", F.lit(0)) + F.coalesce("r2", F.lit(0))).cast("double").alias("weight"))
    membership = graph.communities(weighted)
    ranks = graph.pagerank(edges, docs.select(F.col("doc_id").alias("node")), iterations=100, tolerance=1e-6)
    cuts = cut_spof(edges)
    found = [phantom_hot(phantoms, p.phantom_refs), cuts, thin_spof(edges, membership, cuts), orphans(docs, edges, phantoms), stale_hubs(docs, ranks, now_ms, p)]
    found += [near_duplicates(pairs, edges, p.similarity)] if pairs is not None else []
    found += [cluster_drift(before, membership, p)] if before is not None else []
    reported = docs.where("graph_weight = 'skip'").select("doc_id")
    rows = reduce(DataFrame.unionByName, found).join(reported, "doc_id", "left_anti")
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("score"), "doc_id"))).where(F.col("_n") <= p.per_rule).drop("_n")
    return kept.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), F.desc("score"), "doc_id")


def report(findings: DataFrame) -> DataFrame:
    """One row for each rule: its findings as markdown lines; rules hold at most per_rule findings."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "doc_id", F.lit(" ("), F.format_number("score", 2), F.lit(")"))
    rows = findings.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", line.alias("line")))).alias("r"))
    return rows.select("rule", F.concat(F.lit("## "), "rule", F.lit("\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("markdown"))
