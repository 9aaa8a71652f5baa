"""Streams over stored tables, run to their end into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import new_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def source(spark: SparkSession, d: str, name: str, **options) -> DataFrame:
    """A stream of a table's files, whether the table is one file or a folder of them."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{d}/{name}.parque[t]")


def finished(stream: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Run a stream over all that its sources hold now, and read what it has appended. State lies in RocksDB, which timers and life times need.

    once: in a single batch, for state by processing time, which always has another batch to run.
    """
    spark = stream.sparkSession
    out, before = new_folder(spark, name), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(**({"once": True} if once else {"availableNow": True})).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
