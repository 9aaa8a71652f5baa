"""Parsing, link graph, ranks and lint on the small vault, with values computed by hand or asserted as known."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markdown, text, vectors
from quillspark.operators import feeds, graph, index, lint, recall, search
from quillspark.sources import vault as source
from tests import vault


@pytest.fixture(scope="module")
def docs(spark):
    return markdown.parse(spark.createDataFrame(vault.files(), "path string, content string, mtime long")).cache()


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_parse(docs):
    d = {r["title"]: r for r in docs.collect()}
    assert d["C3"]["links"] == ["C1", "C2", "C4|other"] and d["C1"]["tags"] == ["test"] and d["_reports/R"]["folder"] == "_reports"
    assert d["C1"]["doc_id"] == "c1" and d["C1"]["body"].startswith("# C1")


def test_link_graph(docs):
    edges, phantoms = graph.link_graph(docs.where("folder <> '_reports'"))
    assert graph.undirected(edges).count() == 2 * 20
    assert {r["target"] for r in phantoms.collect()} == {"ph1", "ph2", "ph3"}
    degree = {r["node"]: r["in_degree"] for r in graph.degrees(edges).collect()}
    assert [degree[x] for x in ("c1", "c2", "c3", "c4", "x", "n1", "l1")] == [5, 4, 3, 4, 4, 4, 1]


def test_pagerank(docs):
    own = docs.where("folder <> '_reports'")
    edges, _ = graph.link_graph(own)
    got = {r["node"]: r["score"] for r in graph.pagerank(edges, own.select(F.col("doc_id").alias("node")), iterations=100, tolerance=1e-7).collect()}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-9)
    for node, want in {"c1": 0.138210, "c2": 0.126889, "x": 0.121731, "c4": 0.121021, "n1": 0.062224, "l1": 0.031847, "o1": 0.011152}.items():
        assert abs(got[node] - want) < 2e-6, node


def test_lint(docs):
    pairs = docs.sparkSession.createDataFrame([("n2", "n2x", 0.95), ("n2", "n3", 0.97), ("n2", "n2x", 0.5), ("n2x", "n2", 0.95)], "a string, b string, similarity double")
    before = docs.sparkSession.createDataFrame([(x, "old") for x in ("c1", "c2", "n1", "n2", "n4")], "node string, community string")
    found = lint.run(docs, vault.NOW, pairs=pairs, before=before).collect()
    by = lambda rule: sorted((r["doc_id"], r["severity"], r["score"]) for r in found if r["rule"] == rule)
    assert by("phantom-hot") == [("ph1", "error", 4.0)]
    assert by("bridge-spof") == [("p", "warn", 1.0), ("x", "error", 3.0)]
    assert [x[0] for x in by("orphan")] == ["n2x", "o1", "o2"] and by("orphan")[2][2] == 1.0
    assert by("stale-hub") == [("c1", "warn", 200.0)]
    assert len(by("near-duplicate")) == 1 and len(by("cluster-drift")) == 1
    report = {r["rule"]: r["markdown"] for r in lint.report(lint.run(docs, vault.NOW)).collect()}
    assert report["phantom-hot"].startswith("## phantom-hot\n- [error] ph1") and "near-duplicate" not in report


def test_components_and_communities(docs):
    edges, _ = graph.link_graph(docs.where("folder <> '_reports'"))
    root = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert len(root) == 13 and len(set(root.values())) == 1
    weighted = graph.undirected(edges).where("src < dst").withColumn("weight", F.lit(1.0))
    member = {r["node"]: r["community"] for r in graph.communities(weighted).collect()}
    assert member["n1"] == member["n2"] == member["n3"] and member["c2"] == member["c3"] and member["c2"] != member["n2"]


def test_cut_points(spark):
    def cuts(pairs):
        return values(graph.cut_points(spark.createDataFrame(pairs, "src string, dst string")), "node", "stranded")

    assert cuts([("a", "b"), ("b", "c")]) == [("b", 1)]
    assert cuts([("a", "b"), ("b", "c"), ("c", "a")]) == []
    assert cuts([("s", "a"), ("s", "b"), ("s", "c")]) == [("s", 2)]


def test_sections(spark):
    raw = [("a.md", "lead\n# One\nbody [[x]]\n## Two\nmore\n# One\nagain", 0)]
    got = markdown.sections(markdown.parse(spark.createDataFrame(raw, "path string, content string, mtime long"))).orderBy("pos").collect()
    assert [(r["heading"], r["body"]) for r in got] == [("(intro)", "lead"), ("One", "body [[x]]"), ("Two", "more"), ("One", "again")]
    assert [r["section_id"] for r in got] == ["a_intro", "a_one", "a_two", "a_one_2"] and got[1]["links"] == ["x"]


def test_frontmatter(spark):
    raw = '---\ntitle: "A: b"\ntags:\n  - x\n  - y\nlist: [p, q]\nempty:\n---\nbody'
    got = spark.createDataFrame([(raw,), ("no matter",), ("---\nunclosed",)], "raw string").select(markdown.frontmatter(F.col("raw")).alias("m"), text.strip_frontmatter(F.col("raw")).alias("b")).collect()
    assert got[0]["m"]["title"] == "A: b" and got[0]["m"]["tags"].replace(" ", "") == "x,y" and got[0]["m"]["list"] == "p, q" and got[0]["b"] == "body"
    assert got[1]["m"] == {} and got[1]["b"] == "no matter" and got[2]["b"] == "---\nunclosed"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.tokens(F.lit("Ab c de_1 한국어말 나"))) == ["ab", "de_1", "한국어말", "한국", "국어", "어말", "나"]
    assert one(text.slug(F.lit("Dir/My File!.md"))) == "dir_my_file" and one(text.slug(F.lit("!!.md"))) == "unnamed"
    assert one(text.link_key(F.lit("folder/Name.md#Part|alias"))) == "name" and one(text.link_key(F.lit("Name\\|alias"))) == "name"
    assert one(text.wikilinks(F.lit("![[a.png]] [[b]] and [[c|d]]"))) == ["b", "c|d"]
    assert str(one(text.filename_date(F.lit("note 2026-09-12.md")))) == "2026-09-12" and str(one(text.filename_date(F.lit("990102 x")))) == "1999-01-02"
    assert one(text.filename_date(F.lit("1234567890"))) is None
    assert one(vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(text.nfc(F.lit("é"))) == "é"
    assert one(text.excerpt(F.lit("a" * 70 + "\n\n" + "b" * 60), 100)) == "a" * 70


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "solar power grid"), (2, "solar eclipse"), (3, "cooking rice"), (4, None)], "doc_id long, text string")
    got = index.top(index.bm25(docs, ["solar", "grid"]), 5).collect()
    assert [r["doc_id"] for r in got] == [1, 2] and index.bm25(docs, []).count() == 0
    fused = search.fuse(search.rank(index.bm25(docs, ["solar"]), 5), spark.createDataFrame([(3, 1)], "doc_id long, rank long")).collect()
    assert {r["doc_id"]: r["semantic"] for r in fused} == {1: False, 2: False, 3: True}


def test_personalised_pagerank_keeps_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    got = {r["node"]: r["score"] for r in graph.personalised(edges, spark.createDataFrame([("a", 1.0)], "node string, score double")).collect()}
    assert math.isclose(sum(got.values()), 1) and got["a"] > got["c"]


def test_feeds(spark):
    base, local, remote = (spark.createDataFrame(x, "path string, v string") for x in ([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], [("a", "2"), ("b", "1"), ("c", "2"), ("e", "1")], [("a", "3"), ("b", "2"), ("c", "1"), ("d", "1")]))
    assert dict(values(feeds.conflicts(base, local, remote, "path", "v"), "path", "action")) == {"a": "conflict", "b": "pull", "c": "push", "d": "delete-remote", "e": "push"}
    files = spark.createDataFrame([("a.md",), ("_personal/me/x.md",), ("_personal/you/x.md",)], "path string")
    assert values(feeds.visible(files, "me"), "path") == [("_personal/me/x.md",), ("a.md",)]


def test_scan(spark, tmp_path):
    for name, content in (("a.md", "x"), ("sub/b.md", "y"), (".hidden/c.md", "z"), ("d.txt", "t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    assert values(source.scan(spark, str(tmp_path)), "path", "content") == [("a.md", "x"), ("sub/b.md", "y")]
    assert {r["size"] for r in source.metadata(spark, str(tmp_path)).collect()} == {1}


def test_versions(spark):
    hits = spark.createDataFrame([(1, "plan v1"), (2, "plan v2"), (3, "plan final"), (4, "other")], "doc_id long, name string")
    assert values(search.deduplicate_versions(hits, F.col("name")), "doc_id") == [(3,), (4,)]


def test_recall(docs):
    own = docs.where("folder <> '_reports'")
    edges, _ = graph.link_graph(own)
    hits = docs.sparkSession.createDataFrame([("c1", 3.0), ("n1", 2.0)], "doc_id string, score double")
    got = {(r["role"], r["doc_id"]): r for r in recall.bundle(hits, edges, own, ["n4"], seeds=2, around=3).collect()}
    assert {k for k in got if k[0] == "core"} == {("core", "c1"), ("core", "n1")}
    # P touches both seeds; N4 touches one and is named by the query.
    assert got["around", "n4"]["place"] == 1 and got["around", "n4"]["score"] == 2 + 3 + 0.2 * 4 and ("around", "p") in got
    text = {r["role"]: r["markdown"] for r in recall.render(recall.bundle(hits, edges, own, [], seeds=2)).collect()}
    assert text["core"].startswith("## core\n### C1\n# C1")


def test_cut_points_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(34)] + [(1, 1)]
    near: dict = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = []
    for v in near:
        left, sizes = set(near[v]), []
        while left:
            seen = todo = {next(iter(left))}
            while todo:
                todo = {y for x in todo for y in near[x]} - seen - {v}
                seen = seen | todo
            sizes.append(len(seen))
            left -= seen
        if len(sizes) > 1:
            want.append((v, sum(sizes) - max(sizes)))
    assert values(graph.cut_points(spark.createDataFrame(pairs, "src long, dst long")), "node", "stranded") == sorted(want)
    assert graph.cut_points(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_communities_of_joined_cliques(spark):
    cliques = [(g * 6 + i, g * 6 + j, 1.0) for g in range(4) for i in range(6) for j in range(i)] + [(g * 6, (g + 1) % 4 * 6, 1.0) for g in range(4)]
    found = graph.communities(spark.createDataFrame(cliques, "src long, dst long, weight double")).collect()
    assert {r["node"]: r["community"] for r in found} == {x: x // 6 * 6 for x in range(24)}


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(5)
    docs = {d: [f"w{int(rng.expovariate(0.15))}" for _ in range(12)] for d in range(40)}
    docs[40] = docs[7]  # a copy is its representative's member
    tf = {d: {t: w.count(t) for t in w} for d, w in docs.items()}
    df = {t: sum(t in x for x in tf.values()) for x in tf.values() for t in x}
    vec = {d: {t: c * math.log(1 + (41 - df[t] + 0.5) / (df[t] + 0.5)) for t, c in x.items()} for d, x in tf.items()}
    size = {d: math.sqrt(sum(w * w for w in v.values())) for d, v in vec.items()}
    want = {(a, b): sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items()) / size[a] / size[b] for a in range(40) for b in range(a + 1, 40)}
    posted = spark.createDataFrame([(d, t, c) for d, x in tf.items() for t, c in x.items()], "doc_id long, term string, tf long")
    got = {(r["a"], r["b"]): r["similarity"] for r in graph.similar_pairs(posted, 0.3).collect()}
    assert got.keys() == {k for k, v in want.items() if v >= 0.3} and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    assert {r["doc_id"]: r["representative"] for r in graph.copies(posted).where("doc_id <> representative").collect()} == {40: 7}
