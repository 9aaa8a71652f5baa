"""Vector search under ties, and pooling over all vectors."""

import numpy as np

from quillspark.operators import search


def frame(spark, rows):
    return spark.createDataFrame([(i, g, [float(v) for v in x]) for i, g, x in rows], "vec_id long, label long, embedding array<float>").repartition(3)


def test_ties_go_by_id(spark):
    v = frame(spark, [(i, 0, (1, 0)) for i in range(40)])
    got = search.vector_top(v, v.where("vec_id = 0"), 3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]


def test_pool_reaches_every_group(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 7 if i < 300 else None, r.normal(size=4)) for i in range(310)]
    v = frame(spark, rows)
    unit = {i: x / np.linalg.norm(np.float32(x).astype(float)) for i, _, x in rows}
    want = {}
    for q in (0, 50, 100):
        for i, g, _ in rows:
            s = round(float(unit[q] @ unit[i]), 5)
            if i != q and s > 0:
                want[q, g] = max(want.get((q, g), 0), s)
    got = {(x["query_id"], x["label"]): x["score"] for x in search.vector_pool(v, v.where("vec_id in (0, 50, 100)"), "label", block=2).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    assert search.vector_pool(v.limit(0), v.limit(0), "label").collect() == []


def test_scores_take_a_piece_of_a_batch_at_a_time(spark):
    import pyarrow as pa

    v = frame(spark, [(i, 0, (1, i)) for i in range(3 * search.PIECE + 5)]).coalesce(1)
    emit = lambda ids, b, s: pa.record_batch([pa.array([s.shape[1]])], names=["n"])
    got = [r["n"] for r in search._by_blocks(v, v.where("vec_id < 2"), 1024, [], emit, "n long").collect()]
    assert sum(got) == v.count() and max(got) <= search.PIECE
