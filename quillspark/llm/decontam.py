"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct shingles. An item's sketch is its smallest shingle hashes, as many
as its partition needs: at a containment of t an item of n shingles lacks at most n - ceil(t n) of them, so of one
more than that many sketch values at least one is in every document that holds the item (no false negatives).
Documents test the hashes below each partition's largest sketch value, and documents with too few shingles for a
partition leave it out. Candidates are verified on the shingles themselves.

Defined results: null or empty texts, and items of fewer words than a shingle, match nothing; repeated ids are merged
(a pair is listed once, with its largest containment); null ids pair like any other value. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.common import ascii_lower, shingle_hashes, small_side, stored, words


def _split(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, words(ascii_lower(F.col("text"))).alias("w"))


def _strings(n: int):
    """Space-joined shingles of the column w, distinct."""
    w = F.col("w")
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, threshold: float, n: int) -> DataFrame:
    """item_id, hash, needed (shared shingles that a document must reach) and part (the size partition)."""
    hashed = _split(items, "item_id").select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), n))).alias("h"))
    needed = F.ceil(F.size("h") * threshold - 1e-9).cast("int")
    sized = hashed.withColumns({"needed": needed, "part": F.floor(F.log2(F.size("h").cast("double"))).cast("int")})
    return sized.select("item_id", "needed", "part", F.explode_outer(F.slice("h", 1, F.greatest(F.size("h") - F.col("needed") + 1, F.lit(0)))).alias("hash")).where("hash is not null")


def candidates(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Distinct (doc_id, item_id) whose document holds a value of the item's sketch and has enough shingles."""
    sketch = stored(sketches(items, threshold, n), "sketches")
    parts = [r.asDict() for r in sketch.groupBy("part").agg(F.max("hash").alias("cut"), F.min("needed").alias("least")).orderBy("part").collect()]
    if not parts:
        return docs.sparkSession.createDataFrame([], StructType([docs.schema["doc_id"], items.schema["item_id"]]))
    hashed = _split(docs, "doc_id").select("doc_id", F.array_distinct(shingle_hashes(F.col("w"), n)).alias("h"))
    # By the document's size, the largest sketch value of the partitions that it can hold.
    cut = F.greatest(*[F.when(F.size("h") >= p["least"], F.lit(p["cut"])) for p in parts], F.lit(-(1 << 63)))
    kept = hashed.select("doc_id", F.size("h").alias("m"), cut.alias("cut"), "h").select("doc_id", "m", F.filter("h", lambda x: x <= F.col("cut")).alias("h"))
    # explode() would push its test of the array's size down to the words, which each shingle would then split anew.
    low = kept.select("doc_id", "m", F.explode_outer("h").alias("hash"))
    return low.join(small_side(sketch), "hash").where("m >= needed").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every pair that reaches the threshold."""
    pairs = stored(candidates(docs, items, threshold, n), "candidates").select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i"))
    ids = small_side(stored(pairs.select("_d").distinct(), "candidate-ids"))
    some = _split(docs, "doc_id").join(ids, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    held = some.select("doc_id", _strings(n).alias("in_doc"))
    asked = _split(items, "item_id").select("item_id", _strings(n).alias("in_item"))
    both = held.join(pairs, F.col("doc_id").eqNullSafe(F.col("_d"))).join(asked, F.col("item_id").eqNullSafe(F.col("_i")))
    counted = both.select("doc_id", "item_id", F.size("in_item").cast("long").alias("n_item"), F.size(F.array_intersect("in_item", "in_doc")).cast("long").alias("n_shared"))
    found = counted.where("n_item > 0").withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item", "n_shared"), F.col("containment")).alias("_best"), F.max("containment").alias("containment")).select("doc_id", "item_id", "_best.n_item", "_best.n_shared", "containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of documents that hold no item."""
    ids = contained(docs, items, threshold, n).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(small_side(stored(ids, "contaminated")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
