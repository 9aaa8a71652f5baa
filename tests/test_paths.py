"""Path rules, requests and link resolution on small rows, edges of each included."""

import itertools
import random

from pyspark.sql import functions as F

from quillspark.functions import intent, paths
from quillspark.functions import text as T
from quillspark.operators import resolve, surroundings


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_paths(spark):
    n = paths.normalised
    assert one(spark, "/a\\Café.md", n) == "a/Café.md"
    assert [one(spark, x, n) for x in (None, "", "a//b", "a/.b", "a/\x07b", "_system/x", "x" * 1025, "a/")] == [None] * 8
    assert one(spark, "_systems/x.md", n) == "_systems/x.md"
    assert [one(spark, x, paths.syncable) for x in ("a.PDF", "a/../b.md", "node_modules/a.md", ".x/a.md", "a.txt", None)] == [True, False, False, False, False, False]
    assert [one(spark, x, paths.reactable) for x in ("a.MD", "_x/a.md", "a (Conflict b).md", None)] == [True, False, False, False]
    assert one(spark, "_personal/ann/x/A.md", paths.personal_rest) == "x/A.md" and one(spark, "_personal/ann/", paths.personal_owner) is None
    assert one(spark, "Jürgen M.", paths.owner_segment) == "J-rgen-M." and one(spark, "", paths.owner_segment) == "unknown"
    assert [one(spark, x, lambda c: paths.contains_term(c, "160")) for x in ("a160b", "1600 160", "1600", None)] == [True, True, False, False]
    assert one(spark, "## Description\n" + "x" * 20 + "\n## B\n", paths.described) and not one(spark, "## Description\nshort\n## B\n" + "y" * 30, paths.described)


def test_requests(spark):
    assert one(spark, "전투 밸런스 분석해줘", intent.cleaned) == "전투 밸런스" and one(spark, "분석해줘", intent.cleaned) == "분석해줘"
    assert one(spark, "주간 보고서 만들어줘", intent.cleaned) == "주간" and one(spark, "이름 뽑아줘", intent.verb) == "추출"
    assert [one(spark, x, intent.weight) for x in ("GDD", "a b c d", "what?", None)] == ["simple", "complex", "complex", "simple"]
    assert [one(spark, x, intent.keyword) for x in ("캐", "밸런스", "x", "도움이 필요하시면", "x" * 80, "ok \U0001f389", None)] == [False, True, False, False, False, False, False]
    assert one(spark, "한 문장. " * 60, intent.trimmed).endswith(".") and one(spark, "x" * 300, intent.trimmed) == "x" * 280 + "..."
    assert one(spark, "a [intensity:3] b", intent.trimmed) == "a  b" and one(spark, None, intent.trimmed) == ""


def test_dates(spark):
    at = lambda name, date=None, ms=None: spark.createDataFrame([(name, date, ms)], "n string, d string, m long").select(T.content_date(F.col("n"), F.col("d"), F.col("m"), F.to_date(F.lit("2026-01-01"))).alias("y")).first()["y"]
    assert str(at("[2025_03_07] x.md")) == "2025-03-07" and str(at("25_03_28.md")) == "2025-03-28" and str(at("2027-01-01.md", "2024-05-06")) == "2024-05-06"
    assert str(at("x.md", "soon", 86_400_000)) == "1970-01-02" and at("x.md", None, 0) is None


def test_nearest_is_the_best_of_all_candidates(spark):
    """Against scoring each candidate, with names that most documents share."""
    rng = random.Random(5)
    folders = ["", *["/".join(p) for k in (1, 2, 3) for p in itertools.product("ab", repeat=k)], "B/a"]
    docs = sorted({(rng.choice(folders), rng.choice(["n", "n", "m"]) + ".md") for _ in range(25)})
    rows = [(f"d{i}", f, n) for i, (f, n) in enumerate(docs)]
    asked = [(n, d, f) for n in ("n", "m", "gone") for d in (None, "a", "b/a") for f in folders]
    got = resolve.nearest(spark.createDataFrame(asked, "name string, dirs string, folder string"), spark.createDataFrame(rows, "doc_id string, folder string, filename string"))
    got = {(r["name"], r["dirs"], r["folder"]): r["doc_id"] for r in got.collect()}
    segs = lambda f: [x for x in f.lower().split("/") if x]

    def score(folder, dirs, home):
        a, b = segs(folder), segs(home)
        common = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))))
        explicit = dirs is not None and a[-len(segs(dirs)):] == segs(dirs)
        return 5000 * explicit + 1000 * (a == b) + 10 * common - len(a)

    for n, d, f in asked:
        found = [(-score(folder, d, f), f"{folder}/{name}", i) for i, folder, name in rows if name == f"{n}.md"]
        assert got.get((n, d, f)) == (min(found)[2] if found else None), (n, d, f)


def test_resolve_edges(spark):
    docs = spark.createDataFrame([("a", "x", "A.md", ["a_intro"]), ("b", "", "B.md", None)], "doc_id string, folder string, filename string, sections array<string>")
    links = spark.createDataFrame([("b", "a_intro"), ("b", "A.md"), ("b", "x\\A|alias"), ("b", "b"), ("b", " |z"), ("b", None), ("b", "No Such#p"), ("b", "x/A"), ("b", "x/A")], "src string, link string")
    got = sorted((r["dst"], r["how"]) for r in resolve.resolve(links, docs).collect())
    assert got == [("_phantom_a", "phantom"), ("_phantom_no_such", "phantom"), ("a", "section"), ("a", "subpath"), ("a", "subpath"), ("a", "subpath")]
    assert resolve.resolve(links.limit(0), docs).count() == 0 and resolve.resolve(links, docs.limit(0)).where("how <> 'phantom'").count() == 0


def test_findings_and_patch(spark):
    f = spark.createDataFrame([("r1", "warn"), ("r1", "error"), ("r2", "warn")], "rule string, severity string")
    assert sorted((r["n"] for r in surroundings.findings_count(f).collect())) == [1, 1, 2, 2, 3]
    t = lambda rows: spark.createDataFrame(rows, "k long, v string")
    out = surroundings.patched(t([(1, "a"), (2, "b"), (3, "c")]), t([(2, "new"), (3, "new")]), t([(3, "")]).select("k"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "new")]
