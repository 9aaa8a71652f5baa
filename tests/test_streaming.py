"""The streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from quillspark.streaming import events, reactions

ROWS = [(1, "2026-01-01 00:00:00", "click", 1.0), (1, "2026-01-01 00:10:00", "view", 2.0), (1, "2026-01-01 02:00:00", "click", 3.0), (2, "2026-01-01 00:05:00", "click", 4.0)]


def test_windows_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, make in (("w", lambda e, late: events.windows(e, "1 hour", late=late)), ("s", lambda e, late: events.sessions(e, "30 minutes", late=late))):
        q = make(stream, "1 day").writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        if name == "w":
            assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(rows, None).collect()))
    assert make(rows, None).count() == 3


def test_versions_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "x", False), ("a", 3, "y", False), ("b", 4, "z", False), ("b", 5, "", True)], "path string, seq long, etag string, deleted boolean")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = events.latest_versions(stream).writeStream.format("memory").queryName("versions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["seq"], r["action"]) for r in spark.table("versions").collect()) == [(1, "put"), (2, "skip"), (3, "put"), (4, "put"), (5, "delete")]
    events.upsert(stream, f"{tmp_path}/table", f"{tmp_path}/c2").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/table")
    assert sorted((r["path"], r["seq"], r["deleted"]) for r in got.collect()) == [("a", 3, False), ("b", 5, True)]


def run(spark, tmp_path, name, rows, schema, make):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_reactions(spark, tmp_path):
    hour = 3600
    rows = [("a", 1, "x", 0), ("a", 2, "x", hour), ("a", 3, "y", 2 * hour), ("a", 4, "z", 7 * hour), ("b", 5, "x", 0)]
    got = run(spark, tmp_path, "saves", rows, "path string, seq long, etag string, at long", reactions.reactions)
    assert got == [("a", 1, "react", 0), ("a", 2, "seen", 0), ("a", 3, "deferred", 4 * hour), ("a", 4, "react", 0), ("b", 5, "react", 0)]


def test_spaced(spark, tmp_path):
    day = 86_400
    got = run(spark, tmp_path, "raised", [("a|b", d * day) for d in (0, 3, 6, 8, 14, 15)], "pair string, at long", reactions.spaced)
    assert got == [("a|b", 0), ("a|b", 8 * day), ("a|b", 15 * day)]
