"""Recall of cells against exact search, and vectors of every odd kind."""

import numpy as np
import pytest

from quillspark.operators import nearest, search

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], SCHEMA).repartition(5)


@pytest.mark.parametrize("kind", ["clusters", "random", "copies"])
def test_recall(spark, kind):
    r = np.random.default_rng(3)
    x = {"clusters": lambda: r.normal(size=(20, 16))[r.integers(0, 20, 1200)] + 0.3 * r.normal(size=(1200, 16)), "random": lambda: r.normal(size=(1000, 12)), "copies": lambda: np.repeat(r.normal(size=(60, 8)), 15, axis=0)}[kind]()
    v = frame(spark, x)
    q = v.where("vec_id % 50 = 0")
    exact = search.vector_top(v, q, 10, least=-2.0)
    found = nearest.search(v, q, 10, p=nearest.CellParams(block=100, queries=3)).cache()
    assert nearest.recall(found, exact) >= 0.9
    assert {r["query_id"] for r in found.collect()} == {r["vec_id"] for r in q.collect()} and all(r["query_id"] != r["vec_id"] for r in found.collect())


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    cells = nearest.fit(v)
    assert nearest.recall(nearest.search(v, q, 10, cells), search.vector_top(v, q, 10)) >= 0.9


def test_probing_all_cells_is_exact(spark):
    x = np.random.default_rng(5).normal(size=(300, 6))
    v = frame(spark, x)
    cells = nearest.fit(v)
    every = nearest.Cells(cells.centres, len(cells.centres))
    pairs = lambda df: sorted((r["query_id"], r["vec_id"], r["rank"]) for r in df.collect())
    assert pairs(nearest.search(v, v.where("vec_id % 50 = 0"), 5, every)) == pairs(search.vector_top(v, v.where("vec_id % 50 = 0"), 5, least=-2.0))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [0.9, 0.1])]
    v = spark.createDataFrame(rows, SCHEMA)
    got = {(r["query_id"], r["vec_id"]) for r in nearest.search(v, v.where("vec_id = 6"), 3, nearest.Cells(np.eye(2), 2)).collect()}
    assert got == {(6, 1), (6, 4)}
    assert nearest.search(v.limit(0), v.limit(0)).collect() == [] and nearest.fit(v.where("vec_id in (2, 3)")) is None
