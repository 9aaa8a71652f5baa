"""Passages and budgets on hand-made documents."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context as C


def one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def sections(*pairs):
    return F.array(*[F.struct(F.lit(h).alias("heading"), F.lit(b).alias("body")) for h, b in pairs]) if pairs else F.array().cast(C.SECTIONS)


TERMS = ["red", "blue"]


@pytest.mark.parametrize(
    "body, found, terms, want",
    [
        ("---\na: b\n---\nwhole text", [], None, "whole text"),
        ("whole text", [("One", "no such")], TERMS, "whole text"),
        ("w" * 900, [("(intro)", "# red blue\nnothing"), ("Two", "red " + "y" * 300), ("Three", "RED " + "z" * 300)], TERMS, "### Two\nred " + "y" * 300),
        ("w" * 900, [("One", "red")], TERMS, "w" * 50 + "…"),
        ("w" * 20, [("One", "red")], TERMS, "### One\nred"),
        ("w" * 10, [("Slide 3 red", "x"), ("page 4", "blue")], TERMS, "### Slide 3 red\nx"),
        ("w" * 10, [("page 4", "   "), ("slide 7", "x")], ["slide"], "w" * 10),
        (None, [], TERMS, ""),
        ("", [], None, ""),
    ],
)
def test_what_stands_for_a_document(spark, body, found, terms, want):
    budget = 50 if "…" in want else 5000
    got = one(spark, C.content(F.lit(body).cast("string"), sections(*found), F.array(*[F.lit(t) for t in terms]) if terms else None, F.lit(budget)))
    assert got == want


def test_budgets_labels_and_headers(spark):
    tier = lambda place, chars=0: one(spark, C.tier_budget(F.lit(place), F.lit(chars)))
    assert [tier(p) for p in (1, 3, 4, 8, 9, 14)] == [1500, 1500, 900, 900, 500, 500]
    assert (tier(1, 10_001), tier(1, 60_000), tier(1, 500_000), tier(9, 20_000)) == (1500, 1800, 3000, 600)
    assert [one(spark, C.tier_label(F.lit(p), F.lit(s))) for p, s in ((3, False), (4, False), (9, False), (9, True))] == ["Core", "Related", "Peripheral", "Core"]
    assert [one(spark, C.hop_budget(F.lit(h))) for h in (0, 1, 2, 3, 7)] == [1500, 900, 500, 250, 250] and one(spark, C.hop_label(F.lit(4))) == "4-hop"
    assert [one(spark, C.percent(F.lit(x))) for x in (1.0, 0.9534, 0.0)] == ["100", "95.3", "0"]
    assert one(spark, C.header(F.lit("Core"), F.lit("n"), F.lit("unknown"), F.lit("2024-01-01"), F.lit(""), F.lit(True), F.lit("spec"))) == "[Core] outdated [spec] n [2024-01-01]"
    assert one(spark, C.header(F.lit("Core"), F.lit("n"), F.lit(None).cast("string"))) == "[Core] n" and one(spark, C.header(F.lit("a"), F.lit("n"), F.lit("Ann"), None, F.lit("u"))) == "[a] n (Ann) [source: u]"
    assert one(spark, C.shortened(F.lit("ab  cd"), F.lit(4))) == "ab…"


def test_entries_fit_or_end(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 5), (1, 2, "b" * 9), (1, 3, "c" * 3), (1, 4, None), (2, 1, "d" * 99), (None, 1, "e")], "k int, place int, entry string").repartition(3)
    places = lambda skip: sorted((r["k"], r["place"]) for r in C.fitted(rows, ["k"], 12, 2, skip).collect() if r["k"])
    assert places(False) == [(1, 1)] and places(True) == [(1, 1), (1, 3), (1, 4)]
    assert C.rendered(rows.where("k = 1 and entry is not null"), ["k"], "# L\n").first()["context"] == "# L\n" + "a" * 5 + "b" * 9 + "c" * 3
    assert C.fitted(rows.limit(0), ["k"], 12, 2, True).collect() == []


def test_compressed(spark):
    schema = "k int, place int, header string, content string"
    results = spark.createDataFrame([(1, 1, "h" * 10, "x" * 500), (1, 2, "h" * 10, None), (2, 1, "h", "y"), (3, 1, "h" * 90, "z")], schema)
    near = spark.createDataFrame([(1, 1, "n" * 10, "w" * 500), (1, 2, "n" * 10, "v" * 500), (9, 1, "n", "no results")], schema)
    got = lambda total: sorted((r["k"], r["role"], r["place"], len(r["content"])) for r in C.compressed(results, near, ["k"], total).collect())
    assert got(3000) == [(1, "connected", 1, 201), (1, "connected", 2, 201), (1, "document", 1, 301), (1, "document", 2, 0), (2, "document", 1, 1), (3, "document", 1, 1)]
    assert got(460) == [(1, "connected", 1, 94), (1, "document", 1, 301), (1, "document", 2, 0), (2, "document", 1, 1), (3, "document", 1, 1)]
    assert got(100) == [(1, "document", 1, 71), (2, "document", 1, 1)]
