"""Similar pairs by blocks against brute force; a pair of documents is never shuffled."""

import math
import random

from quillspark.operators import graph


def brute(tf, threshold):
    n = len(tf)
    df = {}
    for x in tf.values():
        for t in x:
            df[t] = df.get(t, 0) + 1
    first = {}
    for d in sorted(tf):
        first.setdefault(tuple(sorted(tf[d].items())), d)
    own = sorted(first.values())
    vec = {d: {t: c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t, c in tf[d].items()} for d in own}
    size = {d: math.sqrt(sum(w * w for w in v.values())) for d, v in vec.items()}
    found = {}
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            s = sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items()) / size[a] / size[b]
            if s >= threshold:
                found[a, b] = s
    return found


def test_near_copies_over_many_terms(spark):
    r = random.Random(8)
    texts = []
    for k in range(160):
        base = [f"rare{r.randrange(6000)}" for _ in range(r.choice([1, 5, 60]))] + [f"often{int(r.expovariate(0.1))}" for _ in range(r.choice([0, 4, 80]))]
        texts += [base] + [[w for w in base if r.random() < 0.9] + ["more"] * r.randrange(3) for _ in range(r.choice([0, 0, 3]))] + [base] * (k % 9 == 0)
    r.shuffle(texts)
    tf = {f"d{i:04}": {t: w.count(t) for t in w} for i, w in enumerate(texts) if w}
    rows = [(d, t, c) for d, x in tf.items() for t, c in x.items()]
    r.shuffle(rows)
    rows += [(None, "rare1", 5), ("d0000", None, 1)]
    found = graph.similar_pairs(spark.createDataFrame(rows, "doc_id string, term string, tf long").repartition(5), 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got, want = {(x["a"], x["b"]): x["similarity"] for x in found.collect()}, brute(tf, 0.8)
    assert len(want) > 150 and got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_nothing(spark):
    assert graph.similar_pairs(spark.createDataFrame([], "doc_id long, term string, tf long"), 0.8).collect() == []
    assert graph.similar_pairs(spark.createDataFrame([(1, "a", 1)], "doc_id long, term string, tf long"), 0.8).collect() == []
