"""Companions of terms by blocks against all pairs; pairs whose counters are too low are never sent."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import companions, terms


def sections(seed, n):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 700}"
    found = [[word() for _ in range(r.randrange(14))] for _ in range(n)]
    found += [[f"twin{k}", f"other{k % 7}", word()] for k in range(20) for _ in range(r.randrange(2, 6))]
    found += [["mit", "license", "free"]] * 300 + [[f"long{k}" for k in range(90)]] * 3
    r.shuffle(found)
    return [" ".join(s) for s in found]


def brute(texts, least, pmi, containment, section_terms, best):
    sets = [set(w for w in t.split() if len(w) > 1) for t in texts]
    sets = [s for s in sets if len(s) > 1]
    df = {t: n for t, n in Counter(t for s in sets for t in s).items() if n >= least}
    c = Counter(p for s in sets for p in combinations(sorted(sorted((t for t in s if t in df), key=lambda t: (df[t], t))[:section_terms]), 2))
    each = {}
    for (a, b), n in c.items():
        x = round(math.log2(n * len(sets) / (df[a] * df[b])), 6)
        if n >= max(least, containment * min(df[a], df[b])) and x >= pmi:
            each.setdefault(a, []).append((-x, b))
            each.setdefault(b, []).append((-x, a))
    return {(t, s, -x, k) for t, found in each.items() for k, (x, s) in enumerate(sorted(found)[:best], 1)}


@pytest.mark.parametrize(("least", "pmi", "containment", "section_terms", "best"), [(3, 2.0, 0.5, 60, 3), (2, 0.5, 0.2, 5, 50)])
def test_against_all_pairs(spark, least, pmi, containment, section_terms, best):
    texts = sections(3, 900)
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "one"]], "text string").repartition(5)
    got = {(r["term"], r["synonym"], r["pmi"], r["rank"]) for r in terms.synonyms(df, least, pmi, containment, section_terms, best).collect()}
    want = brute(texts, least, pmi, containment, section_terms, best)
    assert len(want) > 100 and {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want}
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want))


def test_sections_without_rare_terms(spark):
    for texts in (["all alike"] * 9, ["one here", "two there"], ["single", "", None]):
        assert terms.synonyms(spark.createDataFrame([(t,) for t in texts], "text string")).collect() == []


def test_only_pairs_with_high_counters_are_sent():
    r = random.Random(7)
    texts = [list({f"w{r.randrange(1500)}" for _ in range(12)}) + [f"twin{k % 50}", f"other{k % 50}"] for k in range(3000)]
    df = Counter(w for t in texts for w in t)
    names = sorted((w for w in df if df[w] >= 3), key=lambda w: (df[w], w))
    number = {w: k for k, w in enumerate(names)}
    blocks = []
    for k in range(2):
        (packed,) = companions._rows([companions._block([pa.array(texts[k::2], pa.list_(pa.string()))])])
        own = [(p, number[w], df[w]) for p, w in enumerate(packed["terms"].values.to_pylist()) if w in number]
        pos, ids, dfs = (pa.scalar(list(x), pa.list_(pa.int64())) for x in zip(*own))
        blocks += companions._rows(companions._trimmed({**packed, "block": pa.scalar(k), "pos": pos, "ids": ids, "dfs": dfs}, 1000, 1e9))
    counted = [r for x in blocks for r in companions._counted(x, 1)]
    passed = companions._passed(pa.Table.from_batches(counted), 3, 0.5).to_pylist()
    kind = pa.list_(pa.struct([("codes", pa.list_(pa.int32())), ("bits", pa.binary())]))
    left = [r for k, x in enumerate(blocks) for r in companions._left({**x, "passed": pa.scalar([{c: p[c] for c in ("codes", "bits")} for p in passed if p["block"] == k], kind)}, 1)]
    sent = sum(len(companions._unzipped(r.column("counts")[0], int(np.sum(r.column("sizes")[0].as_py())), False)) for r in left)
    every = Counter((number[a], number[b]) for t in texts for a, b in combinations(sorted((w for w in t if w in number), key=number.get), 2))
    got = companions._summed(pa.Table.from_batches(left), 3, 0.5).to_pylist()
    assert {(r["a"], r["b"], r["c"]) for r in got} == {(*p, n) for p, n in every.items() if n >= max(3, df[names[p[0]]] / 2)}
    assert 0 < sent < len(every) / 4
