"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space and the control characters 9 to 13.
WHITE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if spark not in _LOCAL:
            _LOCAL[spark] = tempfile.mkdtemp(prefix="quillspark-")
        path = _LOCAL[spark]
    return path.rstrip("/")


_LOCAL: dict[SparkSession, str] = {}


def own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored; call it when the results of its operators have been used."""
    from pyarrow import fs

    path = own_folder(spark)
    store, path = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives a lost executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 100_000, size: Column | None = None, max_bytes: int = 32 << 20) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows, and the summed sizes of rows that vary in size, are within the bounds.

    Strings and binaries count themselves; `size` adds what else a row holds. Else the join is left to Spark.
    """
    own = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    each = add_all([F.lit(8 * len(df.columns)), *own, *([F.coalesce(size, F.lit(0))] if size is not None else [])])
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text in order; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITE), "")


def shingle_hashes(w: Column, n: int) -> Column:
    """Hash of each run of n words, in order, repeats included; none if there are fewer words."""
    return F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def add_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def ranked(df: DataFrame, group: list[str], order: list[str], block: Column, finer: Column | None = None, most: int = 4096) -> DataFrame:
    """Add `rank` (from 0) of each row within its group without gathering a group in one task.

    `block` must not decrease along `order` within a group: rows are numbered inside (group, block), and the
    blocks' counts, far fewer than the rows, are summed up to each block's first rank. A block of more than `most` rows
    is cut up by `finer`, which must not decrease along `order` within a block.
    """
    from pyspark.sql import Window

    keys = [f"_g{i}" for i in range(len(group))]
    named = [F.col(g).alias(k) for g, k in zip(group, keys)]
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys)]
    df, inner = df.withColumn("_block", block), []
    if finer is not None:
        big = df.groupBy(*named, F.col("_block").alias("_b")).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        met = df.join(small_side(stored(big, "large-blocks")), reduce(lambda a, b: a & b, same) & F.col("_block").eqNullSafe(F.col("_b")), "left")
        df = stored(met.withColumn("_finer", F.when(F.col("_n").isNotNull(), finer)).drop(*keys, "_b", "_n"), "blocks")
        inner = ["_finer"]
    # One key for the window and the join, in which nulls are equal: the rows are shuffled once.
    df = df.withColumn("_key", F.struct(*[F.col(g).alias(k) for g, k in zip(group, keys)], "_block", *inner))
    counts = df.groupBy(F.col("_key").alias("_k")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_k.{k}" for k in keys]).orderBy("_k._block", *[f"_k.{c}" for c in inner]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).hint("shuffle_hash")
    inside = df.withColumn("_i", F.row_number().over(Window.partitionBy("_key").orderBy(*order)) - 1)
    return inside.join(starts, F.col("_key") == F.col("_k")).withColumn("rank", F.col("_start") + F.col("_i")).drop("_block", "_finer", "_key", "_k", "_i", "_start")
