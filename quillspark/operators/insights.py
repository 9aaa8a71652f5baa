"""What stands out in a link graph, and ranks that mix search with the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import paths


def hubs(edges: DataFrame, least: int = 3, top: int = 12) -> DataFrame:
    """node and refs: the most referred to, repeated references counted."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sum("refs").alias("refs")).where(F.col("refs") >= least).orderBy(F.desc("refs"), "node").limit(top)


def loose(docs: DataFrame, edges: DataFrame, exempt: tuple[str, ...] = ("_index", "currentsituation"), top: int = 20) -> DataFrame:
    """Documents (doc_id, key) that no link touches, but those of index names."""
    met = edges.select(F.col("src").alias("doc_id")).union(edges.select("dst"))
    return docs.where(~F.lower("key").isin(*exempt)).select("doc_id").join(met, "doc_id", "left_anti").orderBy("doc_id").limit(top)


def gaps(phantoms: DataFrame, least: int = 2, top: int = 12) -> DataFrame:
    """target and refs: topics that several documents refer to and none treats."""
    return phantoms.groupBy("target").agg(F.countDistinct("referrer").alias("refs")).where(F.col("refs") >= least).orderBy(F.desc("refs"), "target").limit(top)


def strongest(edges: DataFrame, weight: str, fraction: float) -> DataFrame:
    """Edges not weaker than the strongest fraction's last one; ties with it stay, so the mask doesn't depend on row order."""
    # The weight at the place is found among weights' counts, not by sorting edges.
    n = edges.groupBy(weight).agg(F.count("*").alias("_n"))
    total = edges.count()
    if not total:
        return edges
    at = max(1, -(-total * fraction // 1))
    upto = n.withColumn("_upto", F.sum("_n").over(Window.orderBy(F.desc(weight)).rowsBetween(Window.unboundedPreceding, 0)))
    cut = upto.where(F.col("_upto") >= at).agg(F.max(weight).alias("_cut"))
    return edges.join(F.broadcast(cut)).where(F.col(weight) >= F.col("_cut")).drop("_cut")  # one row


def fused(search: DataFrame, walk: DataFrame, docs: DataFrame, speaker: str | None = None, search_share: float = 0.6) -> DataFrame:
    """doc_id and score: 0.6 of the search score and 0.4 of the walk's, each over its maximum.

    docs: doc_id, status, folder, graph_weight, speaker. Outdated documents count 0.3, of low weight 0.15, the asked speaker's 1.1;
    of skip weight none; a document that the search found itself is neither skipped nor outdated. Nodes without a document go.
    """
    most = search.agg(F.max("score").alias("_a")).join(F.broadcast(walk.agg(F.max("score").alias("_b"))))  # one row each
    both = search.select("doc_id", F.col("score").alias("_s")).join(walk.select("doc_id", F.col("score").alias("_w")), "doc_id", "full_outer").join(docs, "doc_id").join(F.broadcast(most))
    found = F.col("_s").isNotNull()
    share = lambda x, m: F.when(F.col(m) > 0, F.coalesce(x, F.lit(0.0)) / F.col(m)).otherwise(0.0)
    mixed = search_share * share("_s", "_a") + (1 - search_share) * share("_w", "_b")
    decay = F.when(~found & paths.outdated(F.col("status"), F.col("folder")), 0.3).otherwise(1.0) * F.when(F.col("graph_weight") == "low", 0.15).otherwise(1.0)
    boost = F.when(F.col("speaker") == speaker, 1.1).otherwise(1.0) if speaker and speaker != "unknown" else F.lit(1.0)
    kept = both.where((found | ~F.col("graph_weight").eqNullSafe(F.lit("skip"))) & (mixed > 0))
    return kept.select("doc_id", (mixed * decay * boost).alias("score"))


def above_relative(hits: DataFrame, floor: float = 0.35, share: float = 0.6) -> DataFrame:
    """Hits not below the floor, nor below a share of the best score."""
    best = hits.agg(F.max("score").alias("_best"))
    return hits.join(F.broadcast(best)).where((F.col("score") >= floor) & (F.col("score") >= share * F.col("_best"))).drop("_best")  # one row


def whole_if_small(docs: DataFrame, hits: DataFrame, size: Column, budget: int = 60_000) -> DataFrame:
    """doc_id and score: all documents, those without a hit at zero, if the texts fit into the budget together; else the hits."""
    total = docs.agg(F.sum(size).alias("n")).first()["n"] or 0
    if total > budget:
        return hits.select("doc_id", "score")
    return docs.select("doc_id").join(hits.select("doc_id", "score"), "doc_id", "left").na.fill(0.0, ["score"])


def proposals_for(edges: DataFrame, docs: DataFrame, own: DataFrame) -> DataFrame:
    """proposal and targets: proposals (docs: doc_id, path) that link to one's own documents (doc_id); of the order of one person's documents."""
    open_ = docs.where(paths.proposal(F.col("path"))).select(F.col("doc_id").alias("src"))
    met = edges.join(open_, "src", "left_semi").join(own.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    return met.groupBy(F.col("src").alias("proposal")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def batch_dates(docs: DataFrame, day: Column, least: int = 5) -> DataFrame:
    """day and n: days that suspiciously many documents share."""
    return docs.groupBy(day.alias("day")).agg(F.count("*").alias("n")).where(F.col("day").isNotNull() & (F.col("n") >= least))


def matching(docs: DataFrame, text: str) -> DataFrame:
    """Documents whose file name, a tag or a heading holds the text, in any case; all for an empty one."""
    q = text.strip().lower()
    if not q:
        return docs
    held = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(q)))
    hit = F.contains(F.lower("filename"), F.lit(q)) | held(F.col("tags")) | held(F.col("headings"))
    return docs.where(F.coalesce(hit, F.lit(False)))
