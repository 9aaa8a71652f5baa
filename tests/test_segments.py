"""Segments: the newest state by term, pushed filters, compaction beside readers; sections after the fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markdown
from quillspark.operators import folding
from quillspark.session import new_folder
from quillspark.sources import segments

POSTINGS = "doc_id long, term string, tf long"


def held(df):
    return sorted(map(tuple, df.select("doc_id", "term", "tf").collect()))


def test_segments_against_a_rebuilt_index(spark):
    folder = new_folder(spark, "segments")
    rows = lambda r: spark.createDataFrame(r, POSTINGS)
    ids = lambda *r: spark.createDataFrame([(x,) for x in r], "doc_id long")
    segments.create(rows([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "c", 9)]), folder, 2)
    segments.append(rows([(2, "b", 5), (4, "a", 7)]), ids(3), folder, 1)
    segments.append(rows([(3, "a", 1)]), ids(1, 4, 77), folder, 2)
    want = [(2, "b", 5), (3, "a", 1)]
    assert held(segments.postings(spark, folder)) == want
    assert held(segments.postings(spark, folder, ["a", "z"])) == [(3, "a", 1)] and held(segments.postings(spark, folder, [])) == []
    assert held(segments.postings(spark, folder, least="b", below="c")) == [(2, "b", 5)]
    plan = segments.postings(spark, folder, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[a,b\]\)", plan)
    before = segments.postings(spark, folder)
    assert segments.compact(spark, folder, 2) == 1 and segments.newest(spark, folder) == 1
    assert held(before) == want and held(segments.postings(spark, folder)) == want  # readers of the version before go on
    segments.append(rows([(2, "b", 6)]), ids(), folder, 1, version=1)
    assert held(segments.postings(spark, folder)) == [(2, "b", 6), (3, "a", 1)]


def test_an_empty_index(spark):
    folder = new_folder(spark, "segments")
    segments.create(spark.createDataFrame([], POSTINGS), folder)
    assert held(segments.postings(spark, folder)) == [] and segments.compact(spark, folder) == 1
    assert held(segments.postings(spark, folder, ["a"])) == []


def brute(sections, least, most):
    """The fold, one section after the other."""
    join = lambda a, b: (a + "\n\n" + ("" if b[1] == "(intro)" else f"## {b[1]}\n") + b[2]).strip()
    out = []
    for s in sections:
        if out and len(out[-1][2]) < least:
            last = out.pop()
            name = s if last[1] == "(intro)" else last
            out.append((name[0], name[1], join(last[2], s)))
        else:
            out.append(s)
    if len(out) >= 2 and len(out[-1][2]) < least:
        last = out.pop()
        out[-1] = (*out[-1][:2], join(out[-1][2], last))
    done = []
    for i, h, body in out:
        if len(body) <= most:
            done.append((i, h, body))
            continue
        parts, buf = [], ""
        for p in re.split(r"\n\s*\n+", body):
            if not p.strip():
                continue
            if buf and len(buf) + len(p) + 2 > most:
                parts.append(buf.strip())
                buf = p
            else:
                buf = f"{buf}\n\n{p}" if buf else p
        tail = buf.strip()
        if tail and parts and len(tail) < least:
            parts[-1] += "\n\n" + tail
        elif tail:
            parts.append(tail)
        done += [(i if k == 0 else f"{i}_part{k + 1}", h if k == 0 else f"{h} (part {k + 1})", p) for k, p in enumerate(parts)]
    return done


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_against_a_loop(spark, seed):
    r, rows, want = random.Random(seed), [], set()
    for doc in range(60):
        found = []
        for k in range(r.randrange(1, 9)):
            body = "\n\n".join("x" * r.choice([0, 1, 5, 20, 60, 130]) for _ in range(r.randrange(5))).strip()
            found.append((f"{doc}_{k}", "(intro)" if k == 0 and r.random() < 0.5 else f"h{k}", body))
        rows += [(doc, k, *s) for k, s in enumerate(found)]
        want |= {(doc, *x) for x in brute(found, 30, 100)}
    df = spark.createDataFrame(rows, "doc_id long, pos int, section_id string, heading string, body string").repartition(5)
    got = folding.folded(df, 30, 100).collect()
    assert {(x["doc_id"], x["section_id"], x["heading"], x["body"]) for x in got} == want
    assert len({(x["doc_id"], x["at"], x["part"]) for x in got}) == len(got)


def test_folds_of_odd_sections(spark):
    schema = "doc_id long, pos int, section_id string, heading string, body string"
    rows = [(1, 0, "a", "(intro)", None), (2, 0, "b", "h", "y" * 500_000), (3, 0, "c", "h", "see [[A|b]]\n\n" + "z" * 400), (None, 0, "d", "h", "q")]
    got = {x["section_id"]: x for x in folding.folded(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"]["body"] == "" and len(got["b"]["body"]) == 500_000 and got["c"]["links"] == ["A|b"]
    assert folding.folded(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(1, "start\n# One\nshort\n## Two\n" + "w" * 300)], "doc_id long, body string")
    assert [x["heading"] for x in folding.folded(markdown.sections(docs)).collect()] == ["One"]
    assert folding.folded(markdown.sections(docs.withColumn("body", F.lit(None).cast("string")))).collect() == []
