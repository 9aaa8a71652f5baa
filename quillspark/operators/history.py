"""Versions compared line by line, and tasks that are handed on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut


def line_ops(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(kind, line) of a longest common subsequence: ' ' kept, '-' only before, '+' only after; of equal ways the one that removes first.

    Rows of lengths are computed as arrays; what is kept of them is one bit a pair of lines. Equal first lines are taken off
    beforehand, so versions that differ late cost little.
    """
    first = 0
    while first < min(len(before), len(after)) and before[first] == after[first]:
        first += 1
    codes = {line: k for k, line in enumerate(dict.fromkeys(before[first:] + after[first:]))}
    a, b = (np.array([codes[line] for line in x[first:]], dtype=np.int64) for x in (before, after))
    below, drops = np.zeros(len(b) + 1, dtype=np.int32), [b""] * len(a)
    for i in range(len(a) - 1, -1, -1):
        best = np.maximum(below[:-1], below[1:] + (a[i] == b))
        row = np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)
        drops[i] = np.packbits(below[:-1] >= row[1:]).tobytes()
        below = row
    out, i, j = [(" ", line) for line in before[:first]], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((" ", before[first + i]))
            i, j = i + 1, j + 1
        elif drops[i][j >> 3] >> (7 - (j & 7)) & 1:
            out.append(("-", before[first + i]))
            i += 1
        else:
            out.append(("+", after[first + j]))
            j += 1
    return out + [("-", line) for line in before[first + i :]] + [("+", line) for line in after[first + j :]]


def hunks(ops: list[tuple[str, str]], context: int) -> str:
    """Changed lines with so many kept ones around; runs of others between them leave a mark."""
    near = np.zeros(len(ops) + 1, dtype=np.int64)
    for k, (kind, _) in enumerate(ops):
        if kind != " ":
            near[max(0, k - context)] += 1
            near[min(len(ops), k + context + 1)] -= 1
    out, inside = [], False
    for (kind, line), n in zip(ops, np.cumsum(near)):
        if n:
            out.append(f"{kind} {line}")
        elif inside:
            out.append("@@")
        inside = n > 0
    return "\n".join(out)


def diffs(pairs: DataFrame, context: int = 2) -> DataFrame:
    """doc_id, added, removed, unchanged (lines) and diff of each pair of versions (doc_id, before, after). Null: empty; no change: an empty diff.

    A pair is one row and is compared whole, in time by the product of the lines that follow its equal beginning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for old, new in zip(b.column("before"), b.column("after")):
                ops = line_ops((old.as_py() or "").split("\n"), (new.as_py() or "").split("\n"))
                n = {kind: sum(k == kind for k, _ in ops) for kind in "+- "}
                rows.append((n["+"], n["-"], n[" "], hunks(ops, context)))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "added", "removed", "unchanged", "diff"])

    kind = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.select("doc_id", "before", "after").mapInArrow(run, f"doc_id {kind}, added long, removed long, unchanged long, diff string")


def handed_on(tasks: DataFrame, path: Column, now: Column) -> DataFrame:
    """The next task of each finished one that has names left: to, chain (the rest), about (and the finished path), previous, sent.

    tasks: path, kind, status, to, from, chain and about (arrays of names and paths). A hop is sent in the first sender's name.
    """
    ready = tasks.where((F.col("kind") == "task") & F.col("status").isin("done", "answered") & (F.size("chain") > 0))
    return ready.select(
        path.alias("path"), F.lit("task").alias("kind"), F.lit("open").alias("status"), F.element_at("chain", 1).alias("to"), "from", F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0))).alias("chain"),
        F.concat(F.coalesce("about", F.array().cast("array<string>")), F.array("path")).alias("about"), F.col("path").alias("previous"), now.alias("sent"),
    )


def chains(rows: DataFrame) -> DataFrame:
    """id, head, tail, place (from 0), n and next of rows (id, previous): tasks that were handed on, by pointer doubling.

    Each round doubles how far a row sees, so a chain of n rows takes log2 n rounds of joins. A previous that isn't there
    makes a row a head; ids are unique, and no row follows itself by any way. Where several rows follow one, each has a chain,
    next is the smallest of them, and the tail of a head is its last row, the smallest of the last.
    """
    known = rows.select(F.col("id").alias("_p"))
    now = rows.select("id", "previous").join(known, F.col("previous") == F.col("_p"), "left")
    now = cut(now.select("id", F.col("_p").alias("up"), F.when(F.col("_p").isNull(), F.col("id")).alias("head"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("place")))
    links = now.where("up is not null").groupBy(F.col("up").alias("_u")).agg(F.min("id").alias("next"))
    while now.where("head is null").limit(1).count():
        above = now.select(F.col("id").alias("_i"), F.col("up").alias("_up"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        open_ = now.where("head is null").join(above, F.col("up") == F.col("_i"))
        now = cut(now.where("head is not null").unionByName(open_.select("id", F.col("_up").alias("up"), F.col("_head").alias("head"), (F.col("place") + F.col("_place")).alias("place"))))
    last = now.groupBy("head").agg(F.min(F.struct((-F.col("place")).alias("b"), F.col("id"))).alias("_l"), F.count("*").alias("n"))
    return now.join(last, "head").join(links, F.col("id") == F.col("_u"), "left").select("id", "head", F.col("_l.id").alias("tail"), "place", "n", "next")
