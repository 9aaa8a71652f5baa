"""Session defaults and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings stay the cluster's own."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions that name none.
_LOCAL: dict[SparkSession, str] = {}


def own_folder(spark: SparkSession) -> str:
    """What this application stores: a folder of its own below the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if spark not in _LOCAL:
            _LOCAL[spark] = tempfile.mkdtemp(prefix="quillspark-")
        base = _LOCAL[spark]
    return f"{base.rstrip('/')}/quillspark/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared folder and read again: iterations neither grow their plans nor lose work."""
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
