"""Names linked in place, against a loop over all names; ghosts by any length of name."""

import hashlib
import random
import re

from quillspark.operators import rewrite
from quillspark.plans import index

MASKED = re.compile(r"```.*?```|`[^`\n]*`|!?\[\[.*?\]\]|!?\[[^\]]*\]\([^)]*\)|^#.*?$", re.S | re.M)


def loop(body, names):
    """Each name, the longest first, at its first place outside masked spans."""
    if body is None:
        return None
    for name, target in sorted(names.items(), key=lambda x: (-len(x[0]), x[0])):
        if f"[[{target}" in body:
            continue
        pattern = ("(?<![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", name[0]) else "") + re.escape(name) + ("(?![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", name[-1]) else "")
        taken = [m.span() for m in MASKED.finditer(body)]
        for m in re.finditer(pattern, body):
            if not any(a < m.end() and m.start() < z for a, z in taken):
                link = f"[[{name}]]" if name == target else f"[[{target}|{name}]]"
                body = body[: m.start()] + link + body[m.end() :]
                break
    return body


def linked(spark, rows, names):
    docs = spark.createDataFrame(rows, "doc_id long, body string").repartition(4)
    pairs = spark.createDataFrame(sorted(names.items()), "name string, target string")
    return {r["doc_id"]: r["body"] for r in rewrite.link_mentions(docs, pairs).collect()}


def test_random_texts(spark):
    r = random.Random(4)
    words = ["engine", "engine room", "room", "C++", "전투", "전투 시스템", "a", "of", "end", "x_y", "Ende"]
    names = {w: r.choice([w, "Hub", "T " + w]) for w in words}
    bits = [*words, "\n", "## engine head\n", "`engine`", "[[room]]", "![room](x)", "[a](of)", "```\nend of engine\n```", "engines", "backroom", " ", ". ", "을", "전투에서"]
    rows = [(k, "".join(r.choice(bits) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randrange(25)))) for k in range(150)]
    assert linked(spark, rows, names) == {k: loop(t, names) for k, t in rows}


def test_odd_texts(spark):
    names = {"word7": "W", "token": "token", "": "none", "\\E.*": "quote"}
    rows = [(1, None), (2, ""), (3, " ".join(f"word{i % 977} token" for i in range(20_000))), (4, "a \\E.* b"), (5, "# token"), (6, "token"), (6, "token")]
    got = linked(spark, rows, names)
    assert got[1] is None and got[2] == "" and got[4] == "a [[quote|\\E.*]] b" and got[5] == "# token" and got[6] == "[[token]]"
    assert got[3].count("[[") == 2 and got[3].startswith("word0 [[token]]") and "[[W|word7]]" in got[3]
    assert linked(spark, [(1, "x")], {}) == {1: "x"} and linked(spark, [], names) == {}


def test_a_name_of_its_own_stays(spark):
    docs = spark.createDataFrame([(1, "red and blue", "red"), (2, "red and blue", None)], "doc_id long, body string, title string")
    names = spark.createDataFrame([("red", "red"), ("blue", "B")], "name string, target string")
    assert {r["doc_id"]: r["body"] for r in rewrite.link_mentions(docs, names, own="title").collect()} == {1: "red and [[B|blue]]", 2: "[[red]] and [[B|blue]]"}


def test_ghosts_against_all_pairs(spark):
    r = random.Random(9)
    name = lambda: "".join(r.choice("ab가") for _ in range(r.randrange(5)))
    ghosts, titles = [name() for _ in range(60)] + [None], [name() for _ in range(40)] + [None]
    want = {}
    for g in {g for g in ghosts if g}:
        near = [t for t in titles if t and (t.startswith(g) or g.startswith(t))]
        if len(near) == 1:
            want[g] = near[0]
    got = rewrite.replace_ghosts(spark.createDataFrame([(g,) for g in ghosts], "ghost string"), spark.createDataFrame([(t,) for t in titles], "key string")).collect()
    assert {x["ghost"]: x["target"] for x in got} == want and len(got) == len(want)


def test_titles_of_parts_and_suppliers(spark, tmp_path):
    texts = {1: "Supplier#000000007 sells the blue anvil, Supplier#000000007 too", 2: "Supplier#0000000071", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("blue anvil",), (None,)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([("Supplier#000000007",), ("Supplier#000000007",), (None,)], "s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    names = {**dict(index.NAMES), "blue anvil": "blue anvil", "Supplier#000000007": "Supplier#000000007"}
    want = {k: loop(t or "", names) for k, t in texts.items()}
    assert want[1] == "[[Supplier#000000007]] sells [[The|the]] [[blue anvil]], Supplier#000000007 too"
    got = index.title_mentions(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n"], r["digest"]) for r in got} == {k: (len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in want.items()}
