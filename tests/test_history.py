"""Diffs against a plain table of lengths, chains against a walk, and tasks handed on."""

import random

from pyspark.sql import functions as F

from quillspark.operators import history


def plain_ops(a, b):
    n, m = len(a), len(b)
    lcs = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            lcs[i][j] = lcs[i + 1][j + 1] + 1 if a[i] == b[j] else max(lcs[i + 1][j], lcs[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif lcs[i + 1][j] >= lcs[i][j + 1]:
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out + [("-", x) for x in a[i:]] + [("+", x) for x in b[j:]]


def plain_hunks(ops, context):
    keep = [any(ops[x][0] != " " for x in range(max(0, k - context), min(len(ops), k + context + 1))) for k in range(len(ops))]
    out = []
    for k, (kind, line) in enumerate(ops):
        if keep[k]:
            out.append(f"{kind} {line}")
        elif k and keep[k - 1]:
            out.append("@@")
    return "\n".join(out)


def test_a_thousand_pairs():
    r = random.Random(1)
    for _ in range(1000):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(14))] for _ in range(2))
        if r.random() < 0.5:
            b = [x for x in a if r.random() < 0.8] + b[:2]
        ops = history.line_ops(a, b)
        assert ops == plain_ops(a, b)
        assert [x for k, x in ops if k != "+"] == a and [x for k, x in ops if k != "-"] == b
        for context in (0, 1, 2):
            assert history.hunks(ops, context) == plain_hunks(ops, context)


def test_diffs_of_odd_pairs(spark):
    long = "\n".join(f"line {k}" for k in range(3000))
    rows = [(1, "a\nb", "a\nc"), (2, None, None), (3, "", "x"), (4, long, long.replace("line 1500\n", "")), (5, "same", "same"), (5, "same", "same"), (None, "q", None)]
    got = sorted(((r["doc_id"] or 0, r["added"], r["removed"], r["unchanged"], r["diff"]) for r in history.diffs(spark.createDataFrame(rows, "doc_id long, before string, after string")).collect()))
    assert got == [
        (0, 1, 1, 0, "- q\n+ "), (1, 1, 1, 1, "  a\n- b\n+ c"), (2, 0, 0, 1, ""), (3, 1, 1, 0, "- \n+ x"), (4, 0, 1, 2999, "  line 1498\n  line 1499\n- line 1500\n  line 1501\n  line 1502\n@@"), (5, 0, 0, 1, ""), (5, 0, 0, 1, ""),
    ]
    assert history.diffs(spark.createDataFrame([], "doc_id long, before string, after string")).collect() == []


def test_chains(spark):
    rows = [(k, k - 1 if k % 70 else None) for k in range(200)] + [(500, 77_777), (601, 600), (600, None), (602, 600), (603, 602)]
    random.Random(2).shuffle(rows)
    got = {r["id"]: tuple(r)[1:] for r in history.chains(spark.createDataFrame(rows, "id long, previous long")).select("id", "head", "tail", "place", "n", "next").collect()}
    assert len(got) == len(rows) and got[0] == (0, 69, 0, 70, 1) and got[69] == (0, 69, 69, 70, None) and got[199] == (140, 199, 59, 60, None)
    assert got[500] == (500, 500, 0, 1, None) and got[600] == (600, 603, 0, 4, 601) and got[603] == (600, 603, 2, 4, None)
    assert history.chains(spark.createDataFrame([], "id long, previous long")).collect() == []


def test_handed_on(spark):
    rows = [("p1", "task", "done", "b", "a", ["c", "d"], ["x"]), ("p2", "task", "open", "b", "a", ["c"], []), ("p3", "task", "done", "b", "a", [], []), ("p4", "question", "done", "b", "a", ["c"], []), ("p5", "task", "done", "b", "a", ["z"], None), ("p6", "task", "done", "b", "a", None, None)]
    tasks = spark.createDataFrame(rows, "path string, kind string, status string, `to` string, `from` string, chain array<string>, about array<string>")
    got = {r["previous"]: r for r in history.handed_on(tasks, F.concat("path", F.lit("-next")), F.lit(5)).collect()}
    assert set(got) == {"p1", "p5"} and (got["p1"]["to"], got["p1"]["chain"], got["p1"]["about"], got["p1"]["path"]) == ("c", ["d"], ["x", "p1"], "p1-next") and (got["p5"]["chain"], got["p5"]["about"]) == ([], ["p5"])
