"""A bundle of what a corpus knows about a question: best documents, their neighbours, and excerpts within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import excerpt, tokens
from quillspark.operators.graph import undirected


def neighbours(seeds: DataFrame, edges: DataFrame, docs: DataFrame, query: list[str]) -> DataFrame:
    """doc_id, touched, overlap and score of what is linked to a seed and is none itself.

    Two for each seed touched, three for the share of the query in the title, and 0.2 for each of up to five links.
    """
    both = undirected(edges)
    near = both.join(seeds.select(F.col("doc_id").alias("src")), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("touched"))
    near = near.join(seeds.select("doc_id"), "doc_id", "left_anti")
    fan = both.groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("links"))
    held = F.size(F.array_intersect(tokens(F.col("title")), F.array(*map(F.lit, query)).cast("array<string>"))) / max(1, len(query))
    scored = near.join(docs.select("doc_id", "title"), "doc_id").join(fan, "doc_id").withColumn("overlap", held)
    return scored.select("doc_id", "touched", "overlap", (2 * F.col("touched") + 3 * F.col("overlap") + 0.2 * F.least("links", F.lit(5))).alias("score"))


def bundle(hits: DataFrame, edges: DataFrame, docs: DataFrame, query: list[str], seeds: int = 5, around: int = 5, budget: int = 16_000) -> DataFrame:
    """role (core or around), place, doc_id, title, score and excerpt; core has 65 % of the budget, around the rest."""
    core = hits.orderBy(F.desc("score"), "doc_id").limit(seeds)
    near = neighbours(core, edges, docs, query).orderBy(F.desc("score"), "doc_id").limit(around)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    # Bodies join at the end, for a handful of documents.
    rows = core.select(F.lit("core").alias("role"), place.alias("place"), "doc_id", "score").union(near.select(F.lit("around"), place, "doc_id", "score"))
    each = {"core": max(400, int(0.65 * budget) // seeds), "around": max(200, int(0.35 * budget) // around)}
    text = F.when(F.col("role") == "core", excerpt(F.col("body"), each["core"])).otherwise(excerpt(F.col("body"), each["around"]))
    return docs.select("doc_id", "title", "body").join(F.broadcast(rows), "doc_id").select("role", "place", "doc_id", "title", F.round("score", 6).alias("score"), text.alias("excerpt"))  # at most seeds + around rows


def render(found: DataFrame) -> DataFrame:
    """The bundle as one markdown text."""
    line = F.concat(F.lit("### "), "title", F.lit("\n"), "excerpt")
    rows = found.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("r"))
    return rows.select("role", F.concat(F.lit("## "), "role", F.lit("\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n\n")).alias("markdown"))
