"""Chunks, rewriting, associations and feeds."""

from pyspark.sql import functions as F

from quillspark.functions import markdown
from quillspark.operators import audit, chunks, rewrite, social, terms


def test_split_text():
    text = "\n\n".join(" ".join(f"w{i}_{k}" for k in range(i)) for i in range(1, 90, 7))
    parts = chunks.split_text(text, 120, 20)
    assert all(len(p) <= 120 for p in parts) and set(text.split()) == {w for p in parts for w in p.split()}
    assert chunks.split_text("short") == ["short"] and chunks.split_text("") == [] and chunks.split_text("x" * 1000, 100, 0) == ["x" * 100]


def test_chunk_ids(spark):
    got = chunks.chunk(spark.createDataFrame([("d", "s", "a b"), ("d", "t", None)], "doc_id string, section_id string, text string")).collect()
    assert [(r["content"], r["id"]) for r in got] == [("a b", __import__("hashlib").md5(b"d::s::0").hexdigest())]


def test_hub_and_spokes(spark):
    body = "top\n" + "\n".join(f"## Part {k}\n" + "line\n" * 80 for k in range(3))
    got = {r["path"]: r["body"] for r in chunks.hub_and_spokes(spark.createDataFrame([("x/a.md", body), ("b.md", "short")], "path string, body string")).collect()}
    assert set(got) == {"x/a.md", "x/a__01.md", "x/a__02.md", "x/a__03.md", "b.md"} and "- [[a__02]]" in got["x/a.md"] and got["x/a__01.md"].startswith("## Part 0")


def test_rewriting(spark):
    docs = spark.createDataFrame([("a.md", "# Engine\n`Engine` and [[x|Engine]] then Engine part, Engine"), ("b.md", None)], "path string, body string")
    got = {r["path"]: r["body"] for r in rewrite.link_keywords(docs, {"Engine": "hub", "Engine part": "parts"}).collect()}
    assert got["a.md"] == "# Engine\n`Engine` and [[x|Engine]] then [[parts|Engine part]], [[hub|Engine]]" and got["b.md"] is None
    fixed = spark.range(1).select(rewrite.repair_links(F.lit("see [[a] and [[b [[c]] d]]")).alias("x")).first()["x"]
    assert fixed == "see [[a]] and [[c]]"
    ghosts = spark.createDataFrame([("plan",), ("note",), ("zz",)], "ghost string")
    titles = spark.createDataFrame([("plan 2026",), ("note a",), ("note b",)], "key string")
    assert [tuple(r) for r in rewrite.replace_ghosts(ghosts, titles).collect()] == [("plan", "plan 2026")]


def test_tag_peers_and_index(spark):
    files = [(f"{n}.md", f"---\ndate: 2026-0{k}-01\ntags: [t{k % 2}]\n---\nx", 0) for k, n in enumerate("abcd", 1)]
    docs = markdown.parse(spark.createDataFrame(files, "path string, content string, mtime long"))
    assert {r["doc_id"]: r["peers"] for r in rewrite.shared_tag_peers(docs).collect()} == {"a": ["c"], "b": ["d"], "c": ["a"], "d": ["b"]}
    months = {r["month"]: r["markdown"] for r in rewrite.month_index(docs).collect()}
    assert months["2026-02"] == "## 2026-02\n- [[b]] 2026-02-01"


def test_synonyms(spark):
    rows = [("alpha beta",)] * 4 + [("gamma delta word",)] * 2 + [(f"filler{k} other{k}",) for k in range(20)]
    got = {(r["term"], r["synonym"]) for r in terms.synonyms(spark.createDataFrame(rows, "text string")).collect()}
    assert got == {("alpha", "beta"), ("beta", "alpha")}
    assert terms.synonyms(spark.createDataFrame([], "text string")).count() == 0


def test_leaks(spark):
    secret = "the private note says that nobody should read this sentence at all, ever"
    private = spark.createDataFrame([(1, secret), (2, "short"), (3, None)], "private_id long, text string")
    probes = spark.createDataFrame([(7, f"x y  {secret[5:60]} z"), (8, secret[:30]), (9, None), (10, "pad " * 700 + secret)], "probe_id long, text string")
    assert sorted(map(tuple, terms.leaks(private, probes).collect())) == [(1, 7), (1, 10)]


def test_feed(spark):
    posts = spark.createDataFrame([(k, k % 3, k, 100 if k == 4 else 0) for k in range(30)], "post_id long, author_id long, seq long, likes long")
    got = social.feed(posts, spark.createDataFrame([(0, 1), (0, 0)], "reader long, author_id long"), recent=3, trending=1).orderBy("place").collect()
    assert [r["post_id"] for r in got] == [22, 25, 28, 4]  # the newest three, oldest first, then what is trending


def test_audit(spark):
    docs = spark.createDataFrame([("a", "x" * 60), ("a", None), ("b", "---\nk: v\n---\n# H\n[[l]] " + "y" * 400)], "lang string, text string")
    got = {r["lang"]: r for r in audit.counts(docs, ["lang"]).collect()}
    assert got["a"]["stub"] == 1 and got["a"]["thin"] == 1 and got["b"]["no_link"] == 0 and got["b"]["no_heading"] == 0 and got["b"]["no_frontmatter"] == 0


def test_leaks_against_every_window(spark):
    """Repeated characters, blocks' borders, texts of exactly one window, and many places with one hash."""
    import random

    r = random.Random(6)
    secret = ["".join(r.choice("ab ") for _ in range(n)).strip() or "a" for n in (39, 40, 41, 500, 2500)] + ["x" * 200, "", None]
    texts = [secret[3][100:160], secret[4][950:1060], secret[4][2300:2345] + "z" * 3000, "q" * 990 + secret[4][1200:1300], "x" * 39, "x" * 40, "y" + secret[1] + "y", None, "", secret[0]]
    plain = lambda t: " ".join((t or "").split())
    want = {(i, j) for i, s in enumerate(secret) for j, t in enumerate(texts) if any(plain(s)[k : k + 40] in plain(t) for k in range(0, len(plain(s)) - 39, 4))}
    private = spark.createDataFrame(list(enumerate(secret)), "private_id long, text string")
    probes = spark.createDataFrame(list(enumerate(texts)), "probe_id long, text string")
    assert {tuple(x) for x in terms.leaks(private, probes).collect()} == want and len(want) >= 5
    assert terms.leaks(private.limit(0), probes).collect() == []
