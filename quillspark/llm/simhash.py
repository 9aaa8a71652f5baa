"""Near-duplicates by SimHash fingerprints, searched through pivot distance tables.

Spark hashes the word shingles and deals distinct fingerprints to buckets that share some of their bits (fingerprints
at `bits` or fewer differing bits agree on enough whole blocks of bits, so no link is lost). Inside a bucket the
distances to fixed reference fingerprints discard pairs whose coordinates differ by more than `bits`; survivors are
verified on the fingerprints themselves. A bucket gives a spanning forest of its links, never all pairs, and
star contraction over shared tables joins the forests to components.

Defined results: null and empty texts have no shingle and fingerprint zero, linked like any other; repeated rows and
ids are kept, each with its component; a null doc_id has a fingerprint and takes part, but never names a component
unless all its members are null (then the component is null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, stored, words
from quillspark.operators.graph import components


@dataclass(frozen=True)
class SimHashParams:
    """`blocks` whole blocks of bits, of which a bucket fixes `agree`; exact while bits <= blocks - agree.

    `copies` independent fingerprints link documents that are near in any of them.
    """

    shingle: int = 4
    bits: int = 4
    blocks: int = 6
    agree: int = 2
    pivots: int = 12
    direct: int = 256
    copies: int = 1

    def __post_init__(self):
        if self.bits > self.blocks - self.agree:
            raise ValueError("too few blocks: links at the distance `bits` could be lost")


def shingles(w: Column, n: int) -> Column:
    """Space-joined runs of n words, repeats included; the whole sequence if it is shorter.

    `w` must be a column of its own: an expression would be computed anew for each shingle.
    """
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", *[F.get(w, i - 1 + k) for k in range(n)]))
    )


def _spread() -> np.ndarray:
    """For each byte value its eight bits in eight lanes of a 64-bit number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64)[:, 0]


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs of 64-bit hashes that the offsets bound: bits set in over half of a run."""
    n = np.diff(offsets)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # Lanes of 8 bits hold sums of up to 255 hashes, so longer runs are summed in pieces.
    pieces = -(-n[full] // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    starts = np.repeat(offsets[:-1][full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    spread, by_byte = _spread(), np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(spread[by_byte[:, k]], starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        set_bits = 2 * counts > n[full][:, None]
        out[full] |= np.packbits(set_bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def remixed(h: np.ndarray, copy: int) -> np.ndarray:
    """The hashes of the given independent copy: themselves for copy 0, else mixed anew with a constant of the copy."""
    if not copy:
        return h
    h = h ^ np.uint64(copy * 0xD1B54A32D192ED03 % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, n: int = 4, copies: int = 1) -> DataFrame:
    """doc_id and fp0, fp1 ... (the 64 bits as a bigint) of every row."""
    names = [f"fp{k}" for k in range(copies)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h")
            offsets = h.offsets.to_numpy().astype(np.int64)
            values = h.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            fps = [pa.array(majority(remixed(values, k), offsets - offsets[0]).view(np.int64)) for k in range(copies)]
            yield pa.record_batch([b.column("doc_id"), *fps], names=["doc_id", *names])

    split = docs.select("doc_id", words(ascii_lower(F.col("text"))).alias("w"))
    hashed = split.select("doc_id", F.transform(shingles(F.col("w"), n), lambda s: F.xxhash64(s)).alias("h"))
    return hashed.mapInArrow(run, docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in names]).schema)


def references(n: int) -> np.ndarray:
    """Fixed reference fingerprints: multiples of an odd constant, taken modulo 2^64."""
    return np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def distance_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)


def linked(fp: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Square matrix of links: pairs that survive every pivot coordinate, then verified by their own distance."""
    near = np.ones((len(fp), len(fp)), dtype=bool)
    for k in range(table.shape[1]):
        near &= np.abs(table[:, None, k] - table[None, :, k]) <= bits
    a, b = np.nonzero(np.triu(near, 1))
    ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    near[:] = False
    near[a[ok], b[ok]] = near[b[ok], a[ok]] = True
    return near


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a matrix of links the first row that it is connected to."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def bucket_links(fp: np.ndarray, p: SimHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (two arrays of fingerprints) of one bucket of distinct fingerprints."""
    pivots = references(p.pivots)
    if len(fp) <= p.direct:
        table = distance_table(fp, pivots)
        root = forest(linked(fp, table, p.bits))
        own = np.flatnonzero(root != np.arange(len(fp)))
        return fp[own], fp[root[own]]
    # A large bucket: leaders take what lies within `bits` (one link each), then leaders' groups are compared.
    left, leader = np.arange(len(fp)), np.full(len(fp), -1)
    leaders, reach = [], []
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[left[0]])
        own = d <= p.bits
        leader[left[own]] = len(leaders)
        leaders.append(left[0])
        reach.append(int(d[own].max()))
        left = left[~own]
    leaders, reach = np.array(leaders), np.array(reach)
    links = [(fp[i], fp[leaders[leader[i]]]) for i in range(len(fp)) if leaders[leader[i]] != i]
    order = np.argsort(leader, kind="stable")
    bounds = np.searchsorted(leader[order], np.arange(len(leaders) + 1))
    table = distance_table(fp[leaders], pivots)
    parent = list(range(len(leaders)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(leaders) - 1):
        room = p.bits + reach[i] + reach[i + 1 :]
        near = (np.abs(table[i + 1 :] - table[i]) <= room[:, None]).all(axis=1)
        for j in np.flatnonzero(near) + i + 1:
            if np.bitwise_count(fp[leaders[i]] ^ fp[leaders[j]]) > p.bits + reach[i] + reach[j] or top(i) == top(j):
                continue
            a, b = fp[order[bounds[i] : bounds[i + 1]]], fp[order[bounds[j] : bounds[j + 1]]]
            for x in a:
                hit = np.flatnonzero(np.bitwise_count(b ^ x) <= p.bits)
                if len(hit):
                    links.append((x, b[hit[0]]))
                    parent[top(j)] = top(i)
                    break
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def bucket_keys(p: SimHashParams) -> Column:
    """Array of bucket numbers of `fp`: for each choice of `agree` blocks, the choice and the bits in them."""
    edges = [64 * k // p.blocks for k in range(p.blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(p.blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in c))).cast("long")).alias("key")) for k, c in enumerate(combinations(range(p.blocks), p.agree))])


def links(distinct: DataFrame, p: SimHashParams) -> DataFrame:
    """Spanning links src > dst between distinct fingerprints (column fp) that connect all that are near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            now = [b.column(c).to_numpy() for c in ("t", "key", "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            t, key, fp = now
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            edges = np.concatenate([[0], cut])
            # The last bucket may go on in the next batch.
            rest = [x[edges[-1] :] for x in now] if len(fp) else rest
            yield from emit(fp, edges)
        if rest is not None:
            yield from emit(rest[2], np.array([0, len(rest[2])]))

    def emit(fp: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [bucket_links(fp[a:b].view(np.uint64), p) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["src", "dst"])

    keyed = distinct.select(F.explode(bucket_keys(p)).alias("b"), "fp").select("b.t", "b.key", "fp")
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return thinned(dealt.mapInArrow(run, "src long, dst long"))


def contract(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest that it reaches, other than to itself."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, label = at[: len(src)], at[len(src) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            own = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[own], nodes[label[own]]


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: the buckets link a node to many others, which meet in the node's task.

    Each task keeps one edge for each node that it sees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 2
        for b in batches:
            kept = contract(*(np.concatenate([k, b.column(c).to_numpy()]) for k, c in zip(kept, ("src", "dst"))))
        if len(kept[0]):
            yield pa.record_batch([pa.array(x) for x in kept], names=["src", "dst"])

    return edges.repartition("src").mapInArrow(run, "src long, dst long")


def add_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def edges_of(nodes: DataFrame, fp: str, p: SimHashParams) -> DataFrame:
    """Edges src > dst between nodes whose fingerprint in the column fp is the same or near."""
    first = stored(nodes.groupBy(F.col(fp).alias("fp")).agg(F.min("node").alias("first")), "first-nodes")
    same = nodes.join(first, F.col(fp) == F.col("fp")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(first.select("fp"), p)
    a, b = (first.select(F.col("fp").alias(f"_{c}"), F.col("first").alias(c)) for c in "ab")
    near = near.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).select("a", "b")
    return same.union(near).where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))


def groups(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, fp0 ... and component_id (the smallest doc_id that links reach) of every row."""
    names = [f"fp{k}" for k in range(params.copies)]
    node = F.col("fp0") if params.copies == 1 else F.xxhash64(*names)
    fps = stored(fingerprints(docs, params.shingle, params.copies).withColumn("node", node), "fingerprints")
    nodes = stored(fps.groupBy("node").agg(F.min("doc_id").alias("low"), *[F.min(c).alias(c) for c in names]), "distinct-fingerprints")
    edges = links(nodes.select(F.col("fp0").alias("fp")), params) if params.copies == 1 else thinned(add_frames([edges_of(nodes, c, params) for c in names]))
    found = components(edges).withColumnRenamed("node", "_node")
    roots = nodes.join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "low")
    named = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(roots.join(named, "root").select("node", "component_id"), "node").select("doc_id", *names, "component_id")


def representatives(docs: DataFrame, params) -> DataFrame:
    """The rows of one document of each group of near-duplicates; similarity is verified on whole shingle sets (`near`)."""
    from quillspark.llm import near

    return near.representatives(docs, params)
