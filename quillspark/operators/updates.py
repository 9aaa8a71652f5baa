"""Tables kept up to date by change: an index, embeddings, bundles, people and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindexed(postings: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """postings (doc_id, term, tf) after documents have changed or gone: only theirs are replaced, only changed texts are read anew.

    changed: the postings of new and changed documents and, for a document without terms, one row with a null term.
    """
    out = changed.select("doc_id").union(removed.select("doc_id")).distinct()
    gone = removed.select("doc_id").distinct()
    return postings.join(out, "doc_id", "left_anti").unionByName(changed.where("term is not null").join(gone, "doc_id", "left_anti"))


def pending(rows: DataFrame, done: DataFrame, key: str, version: str) -> DataFrame:
    """Rows whose version hasn't been worked on; done: key, version."""
    return rows.join(done.select(key, version), [key, version], "left_anti")


def work_batches(rows: DataFrame, key: str, size: Column, docs: int, batches: int, per_batch: int) -> DataFrame:
    """The rows of the next run with a batch number: at most `docs` rows by key, as far as they fit into the batches.

    The limits are the run's, and what is left is pending in the next one; at most `docs` rows meet in one task.
    """
    first = rows.withColumn("_size", size.cast("long")).orderBy(key).limit(docs)
    before = F.sum("_size").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = first.withColumn("batch", F.floor(before / per_batch).cast("long"))
    return placed.where(F.col("batch") < batches).drop("_size")


def bundle_plan(before: DataFrame, now: DataFrame, key: str, version: str) -> DataFrame:
    """key, version and reused: rows of now, and whether the bundle before held just that version."""
    old = before.select(key, version).distinct().withColumn("_held", F.lit(True))
    return now.select(key, version).join(old, [key, version], "left").select(key, version, F.coalesce("_held", F.lit(False)).alias("reused"))


def seen(people: DataFrame, visits: DataFrame, throttle: int = 600) -> DataFrame:
    """people (sub, first, last in seconds) after visits (sub, at): first is the least, last the latest, moved only if it is at least `throttle` seconds on; new people enter."""
    v = visits.groupBy("sub").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    both = people.select("sub", "first", "last").join(v, "sub", "full_outer")
    moved = F.when(F.col("last").isNull() | (F.col("_last") - F.col("last") >= throttle), F.col("_last")).otherwise(F.col("last"))
    return both.select("sub", F.least("first", "_first").alias("first"), moved.alias("last"))


def keyword_hits(store: DataFrame, found: DataFrame) -> DataFrame:
    """store (keyword, hub, hits) after finds (keyword, hub or null): hits are added up, the newest known hub stays where none is given."""
    new = found.groupBy("keyword").agg(F.max("hub").alias("_hub"), F.count("*").alias("_hits"))
    both = store.join(new, "keyword", "full_outer")
    return both.select("keyword", F.coalesce("_hub", "hub").alias("hub"), (F.coalesce("hits", F.lit(0)) + F.coalesce("_hits", F.lit(0))).alias("hits"))
