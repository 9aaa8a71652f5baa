"""Synonyms, concepts and boosts on hand-made rows: empty tables, nulls, ties and repeated rows."""

from pyspark.sql import functions as F

from quillspark.operators import ranking as R
from quillspark.operators import synonyms

PAIRS = "term string, synonym string"


def expanded(spark, terms, static, mined=()):
    rows = spark.createDataFrame([(1, t) for t in terms], "q long, term string")
    return {r["term"] for r in synonyms.expanded(rows, ["q"], spark.createDataFrame(list(static), PAIRS), spark.createDataFrame(list(mined), PAIRS)).collect()}


def test_two_steps_over_stated_pairs_one_over_mined(spark):
    static = [("a", "b"), ("b", "c"), ("c", "d"), ("m", "n"), ("a", None)]
    assert expanded(spark, ["a", "a", None], static) == {"a", "b", "c"}
    assert expanded(spark, ["x"], static, [("x", "m"), ("m", "z")]) == {"x", "m", "n"}
    assert expanded(spark, ["x"], []) == {"x"} and expanded(spark, [], static) == set()


def test_days_of_padded_numbers(spark):
    assert expanded(spark, ["01", "28", "31", "00", "1"], []) == {"01", "28", "31", "00", "1", "0128", "0131"}
    assert expanded(spark, ["05", "12", "12"], []) == {"05", "12", "0512", "1205"}


DOCS = "doc_id long, title string, body string, rank long, term string, tf long"


def hits(spark, rows, wanted, name=True):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)
    return R.field_hits(docs, {"title": (F.col("title"), 2), "text": (F.col("body"), 1)}, wanted, [], F.col("title") if name else None)


def test_fields_count_as_stated(spark):
    got = {(r["doc_id"], r["term"]): (r["dl"], r["tf"], r["named"], r["first"]) for r in hits(spark, [(1, "red car", "red red blue"), (2, None, None), (3, "", "green")], ["red", "blue"]).collect()}
    assert got == {(1, "red"): (7, 4, True, True), (1, "blue"): (7, 1, False, False), (2, None): (0, None, None, True), (3, None): (1, None, None, True)}


def test_synonyms_of_a_concept_are_capped_and_count_once(spark):
    rows = [(1, "", "sound audio noise " * 20), (2, "", "sound balance"), (3, "", "other words"), (4, "", "more words"), (5, "", "last words")]
    static = spark.createDataFrame([("sound", "audio"), ("sound", "noise")], PAIRS)
    asked = R.concept_terms(spark.createDataFrame([(1, "sound balance nowhere")], "query_id long, text string"), static, spark.createDataFrame([], PAIRS))
    assert {(r["term"], r["concept"]) for r in asked.collect()} == {("sound", "0"), ("audio", "0"), ("noise", "0"), ("balance", "1"), ("nowhere", "2")}
    h = hits(spark, rows, ["sound", "audio", "noise", "balance", "nowhere"], name=False)
    p = R.Scoring(coverage=True, present=True, concept_cap=2.0, absolute=True)
    got = {r["doc_id"]: r for r in R.scored(h, asked, p).collect()}
    # Absent words don't count against anyone; one concept of two, however often, doesn't beat both.
    assert set(got) == {1, 2} and got[2]["matched"] == 2 and got[1]["matched"] == 1 and got[2]["score"] > 0.5
    free = {r["doc_id"]: r["score"] for r in R.scored(h, asked, R.Scoring(coverage=True, present=True)).collect()}
    cap = {r["doc_id"]: r["score"] for r in R.scored(h, asked, R.Scoring(coverage=True, present=True, concept_cap=0.5)).collect()}
    assert cap[1] < free[1]


def test_odd_tables(spark):
    asked = R.flat_terms(spark.createDataFrame([(1, "red"), (1, "red"), (2, "gone")], "query_id long, term string"))
    none = hits(spark, [], ["red"])
    assert R.scored(none, asked, R.Scoring(coverage=True, absolute=True, recency=0.1)).collect() == []
    rows = hits(spark, [(1, "red", "x " * 50_000), (2, "red", None), (2, "red", None), (3, "", "\n")], ["red", "gone"])
    got = R.best(R.scored(rows, asked, R.Scoring(name_boost=1.5)), 10).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(1, 2, 1), (1, 1, 2)]


def test_boosts(spark):
    row = spark.range(1)
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0.0)
    value = lambda c: round(row.select(c.alias("x")).first()["x"], 9)
    tags = lambda *t: R.shared_tags(F.array(*[F.lit(x) for x in t]).cast("array<string>"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    assert value(tags("A", "b", "c")) == 0.2 and value(tags("x", "c")) == 0.1 and value(R.shared_tags(F.lit(None).cast("array<string>"), F.array(F.lit("a")))) == 0
    assert value(R.boosted(F.lit(0.5), yes, F.lit(0.2), F.lit(0.05), no, no, zero)) == 0.675
    assert value(R.boosted(F.lit(0.5), no, zero, zero, yes, yes, zero)) == 0 and value(R.boosted(F.lit(0.9), no, zero, zero, no, no, F.lit(1.0))) == 1
    assert value(R.reranked(F.lit(0.5), F.lit(0.5), yes, yes, F.lit(0.1), F.lit("Guide"), F.lit(-0.05), yes)) == round(0.45 * 1.35 - 0.3, 9)
    lines = F.array(F.lit("  "), F.lit("one RED"), F.lit("red blue"), F.lit("blue red"))
    assert row.select(R.passage(lines, F.array(F.lit("red"), F.lit("blue"))).alias("p")).first()["p"].asDict() == {"pos": 2, "text": "red blue"}
    assert row.select(R.passage(F.array(F.lit(" ")), F.array(F.lit("red"))).alias("p")).first()["p"] is None
