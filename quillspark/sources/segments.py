"""An index as segments: sorted files that are read by term, tombstones of what later segments replace, and compaction.

    folder/version=0/segment=0/postings   doc_id, term, tf, sorted by term in ranges
    folder/version=0/segment=0/removed    doc_id: of older segments, no longer valid

A segment is never changed. A version is complete once it holds a `complete` folder; readers take the newest such version,
so compaction is a new version beside the one that readers still use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS, REMOVED = "doc_id long, term string, tf long", "doc_id long"


def _add(postings: DataFrame, removed: DataFrame, folder: str, files: int) -> None:
    # Sorted by term in ranges: the files' and row groups' least and largest terms tell a lookup which few to read.
    postings.select("doc_id", "term", "tf").repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")
    removed.select("doc_id").distinct().write.parquet(f"{folder}/removed")


def create(postings: DataFrame, folder: str, files: int = 32) -> None:
    """Version 0 with one segment."""
    spark = postings.sparkSession
    _add(postings, spark.createDataFrame([], REMOVED), f"{folder}/version=0/segment=0", files)
    spark.range(1).coalesce(1).write.parquet(f"{folder}/version=0/complete")


def append(postings: DataFrame, gone: DataFrame, folder: str, segment: int, version: int = 0, files: int = 8) -> None:
    """Add a segment: postings of new and changed documents, and gone (doc_id) of deleted ones and of changed ones without terms."""
    replaced = postings.select("doc_id").unionByName(gone.select("doc_id"))
    _add(postings, replaced, f"{folder}/version={version}/segment={segment}", files)


def newest(spark: SparkSession, folder: str) -> int:
    """The newest complete version."""
    return spark.read.format("binaryFile").load(f"{folder}/version=*/complete/*.parquet").select(F.max(F.regexp_extract("path", r"/version=(\d+)/complete/", 1).cast("int"))).first()[0]


def _part(spark: SparkSession, folder: str, version: int, name: str, schema: str) -> DataFrame:
    files = spark.read.schema(schema).parquet(f"{folder}/version={version}/segment=*/{name}")
    return files.withColumn("segment", F.regexp_extract("_metadata.file_path", rf"/segment=(\d+)/{name}/", 1).cast("int"))


def postings(spark: SparkSession, folder: str, terms: list[str] | None = None, least: str | None = None, below: str | None = None) -> DataFrame:
    """doc_id, term and tf of all documents as they are now: of certain terms, of a range of them, or all.

    Terms are filtered in the files' own statistics. A row counts unless a later segment has replaced its document.
    """
    version = newest(spark, folder)
    found = _part(spark, folder, version, "postings", POSTINGS)
    if terms is not None:
        found = found.where(F.col("term").isin(*terms)) if terms else found.limit(0)
    for limit, keep in ((least, F.col("term") >= least), (below, F.col("term") < below)):
        found = found.where(keep) if limit is not None else found
    last = _part(spark, folder, version, "removed", REMOVED).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("segment").alias("_last"))
    live = found.join(last, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").where(F.col("_last").isNull() | (F.col("segment") >= F.col("_last")))
    return live.select("doc_id", "term", "tf")


def compact(spark: SparkSession, folder: str, files: int = 32) -> int:
    """Merge the segments of the newest version into the one segment of a new version; gives its number."""
    version = newest(spark, folder) + 1
    _add(postings(spark, folder), spark.createDataFrame([], REMOVED), f"{folder}/version={version}/segment=0", files)
    spark.range(1).coalesce(1).write.parquet(f"{folder}/version={version}/complete")
    return version
