"""Change logs: rows with a key, a total order `seq` and tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last row of each key, tombstones included; combined before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def live(log: DataFrame, key: str, seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    return latest(log, key, seq).where(~F.col(deleted))


def page(log: DataFrame, since: int, limit: int = 500, seq: str = "seq") -> DataFrame:
    """The next rows after a cursor."""
    return log.where(F.col(seq) > since).orderBy(seq).limit(limit)


def retain(versions: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n versions of each key, with their age rank from 1."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return versions.withColumn("age", F.row_number().over(w).cast("long")).where(F.col("age") <= n)


def with_previous(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each row with the named columns of the row before it in its key (null for the first)."""
    w = Window.partitionBy(key).orderBy(order)
    return log.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def classify(before: DataFrame, now: DataFrame, key: str, version: str) -> DataFrame:
    """key and action: reuse (same version), read (new or changed) or remove (gone)."""
    a = before.select(key, F.col(version).alias("_old"))
    b = now.select(key, F.col(version).alias("_new"))
    action = F.when(F.col("_new").isNull(), "remove").when(F.col("_old") == F.col("_new"), "reuse").otherwise("read")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def cooled(log: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Rows that come at least so long after the row before them in their key (a first row always does)."""
    gap = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(Window.partitionBy(key).orderBy(at, "event_id")).cast("timestamp"))
    return log.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= seconds)).drop("_gap")


def visible(files: DataFrame, viewer: str, column: str = "path") -> DataFrame:
    """Rows outside `_personal/`, and the viewer's own inside."""
    path = F.col(column)
    return files.where(~path.startswith("_personal/") | path.startswith(f"_personal/{viewer}/"))


def conflicts(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, version: str) -> DataFrame:
    """key and action of a three-way sync: none, pull, push, delete or conflict."""
    a, b, c = (df.select(key, F.col(version).alias(n)) for df, n in ((base, "_base"), (local, "_local"), (remote, "_remote")))
    joined = a.join(b, key, "full_outer").join(c, key, "full_outer")
    here, there = ~F.col("_local").eqNullSafe(F.col("_base")), ~F.col("_remote").eqNullSafe(F.col("_base"))
    action = (
        F.when(F.col("_local").eqNullSafe(F.col("_remote")), "none").when(here & there, "conflict")
        .when(there & F.col("_remote").isNull(), "delete-local").when(there, "pull").when(F.col("_local").isNull(), "delete-remote").otherwise("push")
    )
    return joined.select(key, action.alias("action"))


def in_scope(rows: DataFrame, folders: list[str], tags: list[str]) -> DataFrame:
    """Rows (path, tags) in one of a member's folders or with one of their tags; a member without either sees all."""
    if not folders and not tags:
        return rows
    path = F.coalesce(F.col("path"), F.lit(""))
    held = F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]).cast("array<string>")), F.lit(False))
    for folder in folders:
        held = held | F.startswith(path, F.lit(f"{folder.rstrip('/')}/"))
    return rows.where(held)
