"""Windows and state over event streams; the same expressions serve batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less times as instants, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windows(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and value per window and type; rows later than `late` are dropped in a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events with no pause longer than the gap (a debounce)."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_versions(changes: DataFrame) -> DataFrame:
    """A stream of changes (path, seq, etag, deleted) as actions: put, delete, or skip for stale rows and echoes."""

    def act(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, etag = state.get if state.exists else (-1, "")
        out = []
        for b in rows:
            for r in b.sort_values("seq").itertuples():
                own = "" if r.deleted else r.etag
                action = "skip" if r.seq <= seq or own == etag else "delete" if r.deleted else "put"
                if r.seq > seq:
                    seq, etag = int(r.seq), own
                out.append((key[0], int(r.seq), action))
        state.update((seq, etag))
        yield pd.DataFrame(out, columns=["path", "seq", "action"])

    return changes.groupBy("path").applyInPandasWithState(act, "path string, seq long, action string", "seq long, etag string", "append", "NoTimeout")


def upsert(changes: DataFrame, target: str, checkpoint: str, trigger: dict | None = None):
    """Keep a table of the newest row of each path: each batch is appended under its number, readers take the latest."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "seq").alias("r")).select("path", "r.*")
        newest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
