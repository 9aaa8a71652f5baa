"""State by key with timers and a life time: version cursors, reactions with a cool-down, findings raised at most once in a while.

A key's rows of one batch are taken in order of time; what is due before a row happens before it, and what is due after a
key's last row is fired by a timer once the watermark has passed. So rows come out alike however a stream is cut into batches.

Paths are dealt to buckets by a hash, and a path's state is an entry of its bucket's map: a call of
Python, its frames and its timers serve all paths of a bucket, while a batch still reads and writes the entries of its own
paths only. The number of buckets belongs to the state: a stream that goes on must keep it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def _ordered(rows: Iterator[pd.DataFrame], by: list[str], columns: list[str]):
    """The batch's rows of one key as tuples."""
    held = pd.concat(list(rows)).sort_values(by, kind="stable")
    return list(zip(*[held[c].tolist() for c in columns]))


BUCKETS = 4096


def _bucketed(rows: DataFrame, buckets: int):
    """The rows by bucket. Paths go as text, which a null among them leaves as it is."""
    return rows.withColumn("path", F.col("path").cast("string")).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).groupBy("bucket")


class Versions(StatefulProcessor):
    """put, delete, echo (a write that the state knows) or stale, against the newest version of a path; a newer generation starts anew."""

    def init(self, handle) -> None:
        self.now = handle.getMapState("now", "path string", "generation long, seq long, etag string")

    def handleInputRows(self, key, rows, timerValues):
        out, known = [], self.now.exists()
        for path, own_rows in groupby(_ordered(rows, ["path", "seq"], ["path", "seq", "generation", "etag", "deleted"]), key=lambda r: r[0]):
            generation, seq, etag = known and self.now.getValue((path,)) or (None, -1, "")
            for _, s, g, own, gone in own_rows:
                if generation is None or g > generation:
                    generation, seq, etag = g, -1, None
                own = "" if gone else own
                if g < generation or s <= seq:
                    action = "stale"
                else:
                    action = "echo" if own == etag else "delete" if gone else "put"
                    seq, etag = s, own
                out.append((path, s, g, action))
            self.now.updateValue((path,), (generation, seq, etag))
        yield pd.DataFrame(out, columns=["path", "seq", "generation", "action"])

    def close(self) -> None:
        pass


def versions(changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """path, seq, generation and action of a stream of changes (path, seq, generation, etag, deleted)."""
    rows = changes.select("path", "seq", "generation", F.coalesce("etag", F.lit("")).alias("etag"), "deleted")
    found = _bucketed(rows, buckets).transformWithStateInPandas(Versions(), "path string, seq long, generation long, action string", "append", "None")
    return found.withColumn("path", F.col("path").cast(changes.schema["path"].dataType))


class Reactions(StatefulProcessor):
    """One reaction to a version, and none within the cool-down of the last: the newest save of that time waits for its end."""

    def __init__(self, cooldown: int):
        self.cooldown = cooldown

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getMapState("now", "path string", "seq long, etag string, last long, waiting long, waiting_etag string")
        #: For each timer the paths that may wait for it; those that no longer do are passed over when it fires.
        self.due = handle.getMapState("due", "at long", "paths array<string>")

    def handleInputRows(self, key, rows, timerValues):
        out, timers, behind, known = [], {}, timerValues.getCurrentWatermarkInMs(), self.now.exists()
        for path, own_rows in groupby(_ordered(rows, ["path", "at", "seq"], ["path", "at", "seq", "etag"]), key=lambda r: r[0]):
            seq, etag, last, waiting, waiting_etag = known and self.now.getValue((path,)) or (-1, None, None, None, None)
            due = None if waiting is None else last + self.cooldown
            for _, at, s, own in own_rows:
                if at < behind:
                    out.append((path, s, at, "dropped"))
                    continue
                if waiting is not None and at >= last + self.cooldown:
                    last, etag = last + self.cooldown, waiting_etag
                    out.append((path, waiting, last, "reacted late"))
                    waiting = waiting_etag = None
                if s <= seq:
                    action = "dropped"
                elif own == etag:
                    action = "seen"
                elif last is None or at >= last + self.cooldown:
                    action, etag, last = "reacted", own, at
                else:
                    action = "deferred"
                    if waiting is not None:
                        out.append((path, waiting, at, "superseded"))
                    waiting, waiting_etag = s, own
                seq = max(seq, s)
                out.append((path, s, at, action))
            if waiting is not None and last + self.cooldown != due:
                timers.setdefault(last + self.cooldown, []).append(path)
            self.now.updateValue((path,), (seq, etag, last, waiting, waiting_etag))
        for at, paths in timers.items():
            before = self.due.getValue((at,))
            self.due.updateValue((at,), ((list(before[0]) if before else []) + paths,))
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=["path", "seq", "at", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for path in self.due.getValue((at,))[0]:
            seq, _, last, waiting, waiting_etag = self.now.getValue((path,))
            if waiting is not None and at == last + self.cooldown:
                self.now.updateValue((path,), (seq, waiting_etag, at, None, None))
                out.append((path, waiting, at, "reacted late"))
        self.due.removeKey((at,))
        if out:
            yield pd.DataFrame(out, columns=["path", "seq", "at", "action"])

    def close(self) -> None:
        pass


def reactions(saves: DataFrame, cooldown_ms: int = 6 * 3_600_000, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """path, seq, at (ms) and action of a stream of saves (path, seq, etag, ts).

    reacted, deferred, superseded (by a later deferred save), reacted late (when the cool-down ends), seen (the version that
    was reacted to last) or dropped (older than one already met, or behind the watermark, so that late rows can be counted).
    """
    rows = saves.withWatermark("ts", late).select("path", "seq", F.coalesce("etag", F.lit("")).alias("etag"), F.unix_millis("ts").alias("at"))
    found = _bucketed(rows, buckets).transformWithStateInPandas(Reactions(cooldown_ms), "path string, seq long, at long, action string", "append", "EventTime")
    return found.withColumn("path", F.col("path").cast(saves.schema["path"].dataType))


class Raised(StatefulProcessor):
    """A pair is raised if it hasn't been for so long; what is remembered of it has that life time."""

    def __init__(self, apart: int):
        self.apart = apart

    def init(self, handle) -> None:
        self.last = handle.getMapState("raised", "path string, other string", "at long", self.apart)

    def handleInputRows(self, key, rows, timerValues):
        out, known = [], self.last.exists()
        for pair, own_rows in groupby(_ordered(rows, ["path", "other", "at"], ["path", "other", "at"]), key=lambda r: r[:2]):
            before = known and self.last.getValue(pair)
            last = old = before[0] if before else None
            for *_, at in own_rows:
                if last is None or at - last >= self.apart:
                    last = at
                    out.append((*pair, at))
            if last != old:
                self.last.updateValue(pair, (last,))
        yield pd.DataFrame(out, columns=["path", "other", "at"])

    def close(self) -> None:
        pass


def raised(found: DataFrame, apart_ms: int = 7 * 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """path, other and at of a stream of findings (path, other, at in ms), each pair at most once in the time."""
    rows = found.select("path", F.coalesce(F.col("other").cast("string"), F.lit("")).alias("other"), "at")
    pairs = _bucketed(rows, buckets).transformWithStateInPandas(Raised(apart_ms), "path string, other string, at long", "append", "ProcessingTime")
    return pairs.withColumn("path", F.col("path").cast(found.schema["path"].dataType))


def attributed(causes: DataFrame, effects: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Each effect with the causes of the same key at most so long before it: an interval join of two streams (key, id, ts).

    Both watermarks bound the state: a cause is kept until no effect can follow it in time.
    """
    a = causes.withWatermark("ts", late).select(F.col(key).alias("_key"), F.col("id").alias("cause"), F.col("ts").alias("_cause_ts"))
    b = effects.withWatermark("ts", late).select(F.col(key).alias(key), F.col("id").alias("effect"), F.col("ts").alias("_effect_ts"))
    near = (F.col("_key") == F.col(key)) & (F.col("_effect_ts") >= F.col("_cause_ts")) & (F.col("_effect_ts") <= F.col("_cause_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select(key, "cause", "effect")


def delivered_once(rows: DataFrame, ids: list[str], late: str) -> DataFrame:
    """A stream of rows that may come twice: those that repeat an id within the watermark's delay are dropped."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(ids)


def tombstones(notices: DataFrame, listing: DataFrame, still_there: Column | None = None, late: str = "1 hour") -> DataFrame:
    """path of objects that a stream of delete notices (path, hash, ts) names and a listing doesn't hold any more.

    A notice may come twice, and may be stale: what the listing (path) still holds was written again and stays.
    """
    held = listing.where(still_there) if still_there is not None else listing
    once = delivered_once(notices, ["path", "hash"], late)
    return once.join(held.select("path").distinct(), "path", "left_anti").select("path", "hash", "ts")
