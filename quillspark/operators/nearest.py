"""Approximate nearest vectors: coarse cells from a bounded sample, every vector in its cell, queries probe the nearest cells.

Scores inside the probed cells are exact cosines. How many cells are probed follows from the recall that the sample shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut


@dataclass(frozen=True)
class CellParams:
    #: Rows that the cells are trained on: the bound of all that the driver sees.
    sample: int = 10_000
    cells: int = 256
    rounds: int = 12
    #: Recall among the sample's own neighbours that decides how many cells are probed.
    recall: float = 0.97
    #: Vectors and queries that one block of work holds.
    block: int = 4096
    queries: int = 512


@dataclass(frozen=True)
class Cells:
    centres: np.ndarray
    probes: int


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def trained(x: np.ndarray, p: CellParams, k: int) -> Cells:
    """Cells by k-means on unit vectors, from evenly spread first centres, and the fewest probes with the wanted recall of k neighbours."""
    n = max(1, min(p.cells, int(len(x) ** 0.5)))
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(p.rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(n):
            if (own == c).any():
                mean = x[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-300)
    own = (x @ centres.T).argmax(axis=1)
    asked = x[:: max(1, len(x) // 200)]
    s = asked @ x.T
    near = np.argsort(-s, axis=1)[:, : min(k + 1, len(x))]  # with the vector itself
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, own[near], axis=1)  # the probe at which each neighbour is met
    found = [(needed < c).mean() for c in range(1, n + 1)]
    return Cells(centres, next(c for c, share in enumerate(found, 1) if share >= p.recall or c == n))


def fit(vectors: DataFrame, k: int = 10, p: CellParams = CellParams()) -> Cells | None:
    """Cells from at most `sample` vectors, chosen by a hash of their ids; None where there is none."""
    known = vectors.where("embedding is not null and size(embedding) > 0").select("vec_id", "embedding")
    rows = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).collect()
    dims = len(rows[0]["embedding"]) if rows else 0
    rows = [r["embedding"] for r in rows if len(r["embedding"]) == dims]
    return trained(_unit(rows), p, k) if rows else None


def _with_cells(df: DataFrame, cells: Cells, probes: int, name: str) -> DataFrame:
    """vec_id, embedding and the nearest cells, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _unit(b.column("embedding").to_pylist()) @ cells.centres.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield b.append_column(name, pa.array(best.tolist(), pa.list_(pa.int32())))

    dims = cells.centres.shape[1]
    return df.where(F.size("embedding") == dims).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"vec_id long, embedding array<double>, {name} array<int>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: Cells | None = None, p: CellParams = CellParams()) -> DataFrame:
    """query_id, vec_id, score (cosine, 6 places) and rank of about the k nearest vectors of each query, other than itself.

    vectors, queries: vec_id and embedding; null vectors, and those of another length than the cells, are left out. A cell's
    vectors and queries are dealt in blocks, and each pair of blocks is one product: no task holds a cell.
    """
    spark, out = vectors.sparkSession, "query_id long, vec_id long, score double"
    cells = cells or fit(vectors, k, p)
    if cells is None:
        return spark.createDataFrame([], f"{out}, rank long")
    held = cut(_with_cells(vectors, cells, 1, "cells").select("vec_id", "embedding", F.col("cells")[0].alias("cell")))
    asked = cut(_with_cells(queries, cells, cells.probes, "cells").select("vec_id", "embedding", F.explode("cells").alias("cell")))
    blocks = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = cut(blocks(held, p.block, "vb").join(blocks(asked, p.queries, "qb"), "cell"))  # a row for each cell: few
    own = lambda name: F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = held.join(F.broadcast(sizes), "cell").withColumn("v", own("vb")).select("cell", "v", every("qb").alias("q"), "vec_id", "embedding")
    right = asked.join(F.broadcast(sizes), "cell").withColumn("q", own("qb")).select("cell", every("vb").alias("v"), "q", "vec_id", "embedding")

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, query = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        if not len(ids) or not len(query):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        s = np.round(_unit(b.column("embedding").to_pylist()) @ _unit(a.column("embedding").to_pylist()).T, 6)
        s[query[:, None] == ids[None, :]] = -2
        least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        row, at = np.nonzero((s >= least[:, None]) & (s > -1.5))
        return pa.table({"query_id": query[row], "vec_id": ids[at], "score": s[row, at]})

    found = left.groupBy("cell", "v", "q").cogroup(right.groupBy("cell", "v", "q")).applyInArrow(product, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact hits (query_id, vec_id) that were found."""
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
