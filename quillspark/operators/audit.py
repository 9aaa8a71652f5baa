"""Corpus-quality counts over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(text: Column) -> dict[str, Column]:
    """Defects of a text, as booleans."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(F.trim(t))
    return {
        "stub": n < 50,
        "thin": (n >= 50) & (n < 300),
        "no_link": ~F.contains(t, F.lit("[[")),
        "no_heading": ~t.rlike("(?m)^#{1,3} "),
        "no_frontmatter": ~F.startswith(t, F.lit("---\n")),
        "long": n > 20_000,
        "multiline": F.contains(t, F.lit("\n")),
    }


def counts(docs: DataFrame, by: list[str]) -> DataFrame:
    """Total and the number of documents with each defect, for each group."""
    return docs.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in flags(F.col("text")).items()])


def size_histogram(docs: DataFrame, width: int = 1000) -> DataFrame:
    return docs.groupBy((F.floor(F.length(F.coalesce("text", F.lit(""))) / width) * width).cast("long").alias("from_chars")).agg(F.count("*").alias("n"))


def statistics(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by each dimension and in total, in one pass of grouping sets."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    return docs.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def coverage(docs: DataFrame, indexed: DataFrame, by: list[str], gate: float = 0.8) -> DataFrame:
    """total, embedded and pending documents (doc_id) by columns, and whether the share in the index (doc_id) reaches the gate."""
    held = indexed.select(F.col("doc_id").alias("_held")).distinct()
    counts = docs.join(held, F.col("doc_id") == F.col("_held"), "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("_held").alias("embedded"))
    return counts.select(*by, "total", "embedded", (F.col("total") - F.col("embedded")).alias("pending"), (F.col("embedded") >= gate * F.col("total")).alias("ready"))
