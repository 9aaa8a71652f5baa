"""State with timers and life times, cut into batches of files: what one batch gives, several give."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.session import new_folder
from quillspark.streaming import stateful
from quillspark.streaming.runs import finished

HOUR = 3_600_000


def stream(spark, tmp_path, batches, schema):
    """A stream that takes one file, in order, a batch."""
    folder = new_folder(spark, "input")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        path = folder.removeprefix("file:")
        for f in os.listdir(path):
            if f.startswith("part-") and not f.startswith("part-9"):
                os.rename(f"{path}/{f}", f"{path}/part-9{k}.parquet")
                os.utime(f"{path}/part-9{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


#: Times before a stream's first watermark (the epoch) would be late.
BASE = 1_700_000_000_000


def since(c):
    return F.timestamp_millis(F.lit(BASE) + F.expr(c))


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


SAVES = [("a", 1, "x", 0), ("a", 2, "y", HOUR), ("a", 3, "z", 2 * HOUR), ("b", 4, None, 3 * HOUR), ("a", 5, "z", 6 * HOUR + 1), ("a", 6, "w", 7 * HOUR), ("c", 7, "q", 30 * HOUR), ("c", 8, "r", 31 * HOUR), ("d", 9, "q", 38 * HOUR)]
WANT = [
    ("a", 1, 0, "reacted"), ("a", 2, HOUR, "deferred"), ("a", 2, 2 * HOUR, "superseded"), ("a", 3, 2 * HOUR, "deferred"), ("a", 3, 6 * HOUR, "reacted late"), ("a", 5, 6 * HOUR + 1, "seen"), ("a", 6, 7 * HOUR, "deferred"),
    ("a", 6, 12 * HOUR, "reacted late"), ("b", 4, 3 * HOUR, "reacted"), ("c", 7, 30 * HOUR, "reacted"), ("c", 8, 31 * HOUR, "deferred"), ("c", 8, 36 * HOUR, "reacted late"), ("d", 9, 38 * HOUR, "reacted"),
]


@pytest.mark.parametrize("cuts", [[], [2, 5], [1, 2, 3, 4, 6, 7, 8]])
def test_deferred_saves_fire_when_the_cooldown_ends(spark, tmp_path, cuts):
    batches = [SAVES[a:b] for a, b in zip([0, *cuts], [*cuts, len(SAVES)])]
    saves = stream(spark, tmp_path, batches, "path string, seq long, etag string, at long").withColumn("ts", since("at"))
    assert got(finished(stateful.reactions(saves, 6 * HOUR, "1 minute"), "r"), "path", "seq", "at", "action") == [(path, seq, at + BASE, action) for path, seq, at, action in WANT]


def test_a_new_generation_starts_anew(spark, tmp_path):
    batches = [[("a", 1, 1, "x", False), ("a", 2, 1, "x", False), ("b", 3, 1, "y", False)], [("a", 2, 1, "x", False), ("a", 1, 2, "x", False), ("b", 4, 1, None, True), ("b", 5, 1, "", True)], [("a", 9, 1, "z", False), ("a", 2, 2, "x", False), ("b", 6, 1, "y", False)]]
    rows = stream(spark, tmp_path, batches, "path string, seq long, generation long, etag string, deleted boolean")
    assert got(finished(stateful.versions(rows), "v"), "path", "generation", "seq", "action") == [
        ("a", 1, 1, "put"), ("a", 1, 2, "echo"), ("a", 1, 2, "stale"), ("a", 1, 9, "stale"), ("a", 2, 1, "put"), ("a", 2, 2, "echo"), ("b", 1, 3, "put"), ("b", 1, 4, "delete"), ("b", 1, 5, "echo"), ("b", 1, 6, "put"),
    ]


def test_pairs_are_raised_once_in_a_while(spark, tmp_path):
    day = 86_400_000
    rows = stream(spark, tmp_path, [[("a", "b", d * day) for d in (0, 3, 6, 8, 14, 15)] + [("a", None, 5)] * 2 + [("c", "b", day)]], "path string, other string, at long")
    assert got(finished(stateful.raised(rows), "p", once=True), "path", "other", "at") == [("a", "", 5), ("a", "b", 0), ("a", "b", 8 * day), ("a", "b", 15 * day), ("c", "b", day)]


def test_streams_meet_within_an_interval_over_batches(spark, tmp_path):
    ts = lambda rows: rows.withColumn("ts", since("s * 1000"))
    causes = ts(stream(spark, tmp_path, [[(1, 10, 0), (1, 11, 50)], [(2, 12, 100), (None, 13, 100)]], "k long, id long, s long"))
    effects = ts(stream(spark, tmp_path, [[(1, 20, 60), (2, 21, 90)], [(2, 22, 160), (2, 23, 161), (None, 24, 110)]], "k long, id long, s long"))
    assert got(finished(stateful.attributed(causes, effects, "k", "60 seconds", "5 minutes"), "j"), "k", "cause", "effect") == [(1, 10, 20), (1, 11, 20), (2, 12, 22)]


def test_notices_come_twice_or_too_late(spark, tmp_path):
    rows = stream(spark, tmp_path, [[("a", "1", 0), ("b", "1", 0)], [("a", "1", 5), ("c", "2", 6), (None, None, 7)]], "path string, hash string, s long").withColumn("ts", since("s * 1000"))
    listing = spark.createDataFrame([("b", 1), ("c", 0)], "path string, alive int")
    assert {tuple(r) for r in finished(stateful.tombstones(rows, listing, F.col("alive") == 1), "t").select("path", "hash").collect()} == {("a", "1"), ("c", "2"), (None, None)}


def test_late_rows_leave_the_state_alone(spark, tmp_path):
    rows = [[("a", 1, "x", 0)], [("a", 2, "y", 100 * HOUR)], [("a", 3, "z", HOUR)], [("b", 4, "x", 101 * HOUR)]]
    saves = stream(spark, tmp_path, rows, "path string, seq long, etag string, at long").withColumn("ts", since("at"))
    assert got(finished(stateful.reactions(saves, 6 * HOUR, "1 minute"), "l"), "seq", "action") == [(1, "reacted"), (2, "reacted"), (3, "dropped"), (4, "reacted")]


def test_empty_stream(spark, tmp_path):
    saves = stream(spark, tmp_path, [[]], "path string, seq long, etag string, at long").withColumn("ts", since("at"))
    assert finished(stateful.reactions(saves), "e").collect() == []


MET = [("a", 1, "x", 0), ("b", 2, "x", 0), (None, 3, "x", 0), ("a", 4, "y", HOUR), (None, 5, "y", HOUR), ("b", 6, "y", 2 * HOUR), ("a", 7, "z", 5 * HOUR), ("e", 8, "q", 30 * HOUR), ("b", 9, "w", 31 * HOUR), ("f", 10, "q", 40 * HOUR)]
MET_WANT = [
    ("a", 1, 0, "reacted"), ("a", 4, HOUR, "deferred"), ("a", 4, 5 * HOUR, "superseded"), ("a", 7, 5 * HOUR, "deferred"), ("a", 7, 6 * HOUR, "reacted late"), ("b", 2, 0, "reacted"), ("b", 6, 2 * HOUR, "deferred"), ("b", 6, 6 * HOUR, "reacted late"),
    ("b", 9, 31 * HOUR, "reacted"), (None, 3, 0, "reacted"), (None, 5, HOUR, "deferred"), (None, 5, 6 * HOUR, "reacted late"), ("e", 8, 30 * HOUR, "reacted"), ("f", 10, 40 * HOUR, "reacted"),
]


@pytest.mark.parametrize("cuts", [[], [4, 6, 8], [1, 2, 3, 4, 5, 6, 7, 8, 9]])
def test_paths_of_a_bucket_that_wait_for_the_same_time(spark, tmp_path, cuts):
    batches = [MET[a:b] for a, b in zip([0, *cuts], [*cuts, len(MET)])]
    saves = stream(spark, tmp_path, batches, "path string, seq long, etag string, at long").withColumn("ts", since("at"))
    rows = finished(stateful.reactions(saves, 6 * HOUR, "1 minute", buckets=1), "bucket").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(((path, seq, at + BASE, action) for path, seq, at, action in MET_WANT), key=repr)


@pytest.mark.parametrize("buckets", [1, 7])
def test_versions_of_many_paths_share_a_bucket(spark, tmp_path, buckets):
    big = 2**60 + 1
    batches = [[(p, s, 1, "x", None) for p in (None, 1, 2, big) for s in (2, 1)], [(p, s, 1, "x" if p == 1 else "y", False) for p in (None, 1, big) for s in (2, 3)]]
    rows = stream(spark, tmp_path, batches, "path long, seq long, generation long, etag string, deleted boolean")
    got = finished(stateful.versions(rows, buckets), "bucket").collect()
    want = [(p, s, 1, {1: "put", 2: "echo"}[s]) for p in (None, 1, 2, big) for s in (1, 2)] + [(p, s, 1, "stale" if s == 2 else "echo" if p == 1 else "put") for p in (None, 1, big) for s in (2, 3)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_pairs_of_many_paths_share_a_bucket(spark, tmp_path):
    day = 86_400_000
    rows = stream(spark, tmp_path, [[(p, o, d * day) for p in (None, 1, 2**60 + 1) for o in ("b", None) for d in (0, 3, 8)]], "path long, other string, at long")
    got = finished(stateful.raised(rows, buckets=1), "p", once=True).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(p, o, d * day) for p in (None, 1, 2**60 + 1) for o in ("b", "") for d in (0, 8)], key=repr)
