"""A count-min sketch of 128-bit digests that tells once from more than once, built and merged by tasks.

Counters stop at two, so a counter is two bits. An estimate is never too small: an estimate of one proves that a digest
was seen once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillspark.llm.common import stored

ROWS = 3
#: Counters that one piece of a sketch holds.
PIECE = 1 << 16


def cells(a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each digest in each row of the sketch (width is a power of two)."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return [((a + np.uint64(r) * b) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(ROWS)]


def _piece(counts: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(counts == 1).tobytes() + np.packbits(counts > 1).tobytes(), 1)


def _counts(piece: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(piece), dtype=np.uint8)).reshape(2, PIECE)
    return bits[0] + 2 * bits[1]


def _merged(table: pa.Table, by: list[str]) -> pa.Table:
    total = np.zeros(PIECE, dtype=np.uint8)
    for piece in table.column("piece"):
        total = np.minimum(total + _counts(piece.as_py()), 2)
    return pa.table({c: table.column(c).slice(0, 1) for c in by} | {"piece": pa.array([_piece(total)], pa.binary())})


def width_for(rows: int, most: int = 1 << 27) -> int:
    """Counters a row: at least eight for each digest, up to a bound that fits memory; beyond it estimates get larger, never smaller."""
    return min(most, 1 << max(16, (8 * rows - 1).bit_length()))


def repeated(df: DataFrame, a: str, b: str, width: int) -> np.ndarray:
    """Bits of the counters that reached two. A task sends pieces of its counters; they are merged in two steps, by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * width, dtype=np.uint8)
        for batch in batches:
            for at in cells(batch.column(a).to_numpy(), batch.column(b).to_numpy(), width):
                at, n = np.unique(at, return_counts=True)
                counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)
        part = TaskContext.get().partitionId() % 256
        for k in range(0, len(counts), PIECE):
            if counts[k : k + PIECE].any():
                yield pa.record_batch([pa.array([k // PIECE]), pa.array([part]), pa.array([_piece(counts[k : k + PIECE])])], names=["k", "part", "piece"])

    pieces = df.select(a, b).mapInArrow(run, "k long, part long, piece binary")
    by_part = pieces.groupBy("k", "part").applyInArrow(lambda t: _merged(t, ["k", "part"]), "k long, part long, piece binary")
    merged = by_part.groupBy("k").applyInArrow(lambda t: _merged(t, ["k"]), "k long, piece binary")
    out = np.zeros(ROWS * width // 8, dtype=np.uint8)
    for r in stored(merged, "sketch").toLocalIterator():
        out[r["k"] * (PIECE // 8) : (r["k"] + 1) * (PIECE // 8)] = np.packbits(_counts(bytes(r["piece"])) > 1)
    return out


def once(bits: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """True where the estimate is one: of a digest that is in the sketch, some counter was reached by it alone."""
    out = np.zeros(len(a), dtype=bool)
    for at in cells(a, b, width):
        out |= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
    return out
