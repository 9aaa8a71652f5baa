"""Scans of document folders and stores of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _relative(root: str) -> Column:
    path = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", "\\+", "%2B")), "^file:/+", "/")
    return F.regexp_replace(path, f"^.*?{root.rstrip('/').replace('.', '[.]')}/", "")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, content and mtime (ms) of every markdown file outside dot folders."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    out = files.select(_relative(root).alias("path"), F.col("value").alias("content"), F.unix_millis("_metadata.file_modification_time").alias("mtime"))
    return out.where(~F.col("path").rlike("(^|/)\\."))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime and size without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return files.select(F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "").alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


def write_index(postings: DataFrame, path: str, files: int = 32) -> None:
    """Postings sorted by term in ranges, so that a term's lookup reads few row groups."""
    postings.repartitionByRange(files, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def stale(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of (doc_id, mtime) that the cache doesn't hold in their present version."""
    return current.join(cached.select("doc_id", "mtime"), ["doc_id", "mtime"], "left_anti")
