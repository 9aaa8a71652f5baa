"""Tokens with particles and the incremental tables, on edges that the queries' data doesn't have."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import insights, updates


def test_stems(spark):
    r = lambda q: spark.createDataFrame([(q,)], "q string").select(T.primary_stems(F.col("q")).alias("p"), T.sub_stems(F.col("q")).alias("s"), T.weighted_stems(F.col("q")).alias("w")).first()
    assert r("전투시스템에서는 28일")["p"] == ["전투시스템에서는", "전투시스템", "28"] and r("전투시스템")["s"] == ["전투", "투시", "시스", "스템"]
    assert r("집이 2026년 1월")["p"] == ["집이", "2026", "01"]  # a particle must leave two characters
    assert r("캐릭터 캐릭")["w"] == {"캐릭터": 1.0, "캐릭": 1.0, "릭터": 0.3}
    assert r(None)["p"] == [] and r("")["w"] == {} and r("Ab, a-b")["p"] == ["ab"]


def test_index_updates(spark):
    p = lambda rows: spark.createDataFrame(rows, "doc_id long, term string, tf long")
    got = updates.reindexed(p([(1, "a", 1), (2, "b", 2), (3, "c", 3)]), p([(2, "x", 1), (3, None, None), (4, "d", 1)]), p([(4, "", 0)]).select("doc_id"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, "x", 1)]
    rows = spark.createDataFrame([(i, 40) for i in range(6)], "k long, n long")
    assert [r["batch"] for r in updates.work_batches(rows, "k", F.col("n"), 5, 2, 100).orderBy("k").collect()] == [0, 0, 0, 1, 1]
    assert updates.work_batches(rows.limit(0), "k", F.col("n"), 5, 2, 100).count() == 0


def test_strongest_keeps_ties(spark):
    e = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 1)], "src long, w long")
    assert sorted(r["src"] for r in insights.strongest(e, "w", 0.25).collect()) == [1, 2, 3] and insights.strongest(e.limit(0), "w", 0.5).count() == 0


def test_segments(spark):
    got = spark.createDataFrame([("[[a]]\n[b] [[c|d]]",), (None,)], "t string").select(T.segments(F.col("t")).alias("s")).collect()
    assert [tuple(x) for x in got[0]["s"]] == [("link", "a"), ("text", "\n[b] "), ("link", "c|d")] and got[1]["s"] == []
