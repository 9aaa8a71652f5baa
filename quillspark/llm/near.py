"""Near-duplicates by SimHash fingerprints and exact Jaccard similarity of shingle sets.

Fingerprints (`simhash`: blocks of bits, pivot distance tables, spanning links) come first: what they find within `bits`
differing bits is verified on whole sets, since near fingerprints don't show that sets are similar. Nor are those of
similar sets always near, so an exact prefix filter follows for the pairs that verified links don't join yet.

Two sets that share 4/5 of their union share an element among the first fifth of each in any common order, so sets that
meet in no bucket of such elements can't be similar: no pair is lost. The order puts shingles that a sample of
documents shows to be common last; it decides how many candidates there are, not which links are found. Each candidate
pair is then verified on the whole sets; only pairs that reach the similarity are links, and links joined make groups.
Beyond the shorter prefix a pair shares at most what is left of its set, so pairs that share too few prefix elements for
the rest to make up are dropped before; that bound loses no pair either.

Buckets of more than `direct` sets are compared in rounds: neighbours by size first; then, `rounds` times, each set with
the `partners` sets of nearest signature that no link joins it to yet; at last all pairs that are still apart. A group of
many near copies is joined by the first rounds, so that few pairs are left for the last one. A signature has 256 bits,
each taken from the smallest of the set's hashes under a mixing of its own, and bits differ with a chance of
(1 - similarity) / 2: sets at 0.8 differ in more than 64 bits with a chance below 1e-11, and such pairs are left out.
Equal sets are one node from the start, so copies cost nothing.

Defined results: null and empty texts have the empty set and are copies of each other; texts shorter than a shingle are
one shingle; a null doc_id takes part, but never names a group unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, small_side, stored, words
from quillspark.llm.simhash import SimHashParams, edges_of, majority, references, remixed, shingles
from quillspark.operators.graph import components


@dataclass(frozen=True)
class NearParams:
    """Similarity `num` / `den` of sets of `shingle` words; the others trade time only."""

    shingle: int = 5
    num: int = 4
    den: int = 5
    bits: int = 4
    direct: int = 8
    rounds: int = 2
    partners: int = 4
    differing: int = 64
    sample: int = 20_000
    common: int = 100_000


SIGNATURE = [f"g{k}" for k in range(4)]
#: A prefix's elements as bits of a map, and how many elements found their bit taken.
PREFIX = [f"p{k}" for k in range(8)] + ["taken"]
OWN = [*SIGNATURE, *PREFIX, "fp0"]


def prefix_map(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(512, dtype=np.uint8)
    bits[(h.view(np.uint64) >> np.uint64(55)).astype(np.int64)] = 1
    return np.append(np.packbits(bits).view(np.int64), len(h) - int(bits.sum()))


def signature(h: np.ndarray) -> np.ndarray:
    """256 bits, as four numbers, of a set of hashes: a bit of the smallest product with each of 256 odd constants."""
    out = np.zeros(256, dtype=np.uint8)
    mixers = references(512)[256:] | np.uint64(1)
    step = max(1, (1 << 18) // max(1, len(h)))
    for k in range(0, 256, step):
        out[k : k + step] = (h.view(np.uint64)[None, :] * mixers[k : k + step, None]).min(axis=1, initial=np.uint64(2**64 - 1)) >> np.uint64(20) & np.uint64(1)
    return np.packbits(out).view(np.int64)


def hashed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_id (a hash of the text) and h, the hashes of its shingles, repeats included."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_id"), words(ascii_lower(F.col("text"))).alias("w"))
    return split.select("doc_id", "text_id", F.transform(shingles(F.col("w"), n), lambda s: F.xxhash64(s)).alias("h"))


def common_shingles(docs: DataFrame, p: NearParams) -> np.ndarray:
    """Hashes of the shingles that most documents of a sample hold, rarest first."""
    every = max(1, docs.count() // p.sample)
    held = hashed(docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0), p.shingle).select(F.explode(F.array_distinct("h")).alias("s"))
    found = held.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(p.common).select("s")
    return np.array([r[0] for r in found.toLocalIterator()][::-1], dtype=np.int64)


def sets(docs: DataFrame, common: np.ndarray, p: NearParams, whole: bool) -> DataFrame:
    """doc_id, text_id, node (a hash of the set), n (its size) and s: the whole set, or the prefix that a similar set must meet, with the signature, the prefix's map and the fingerprint."""
    order = np.argsort(common)
    known, place = common[order], order.astype(np.uint64)

    def one(h: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        h = np.unique(h)
        node = int((remixed(h.view(np.uint64), 1).sum(dtype=np.uint64) + np.uint64(len(h))).view(np.int64))
        if whole or not len(h):
            return node, len(h), h, np.zeros(len(SIGNATURE) + len(PREFIX), np.int64)
        key = h.view(np.uint64) >> np.uint64(1)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            key[hit] = np.uint64(1 << 63) + place[at[hit]]
        first = len(h) - -(-p.num * len(h) // p.den) + 1
        prefix = h[np.lexsort((h, key))[:first]]
        return node, len(h), prefix, np.concatenate([signature(h), prefix_map(prefix)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h")
            offsets, values = h.offsets.to_numpy(), h.values.to_numpy()
            found = [one(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            node, n, s, g = zip(*found) if found else ((), (), (), ())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *s])))
            fp = majority(values[offsets[0] : offsets[-1]].view(np.uint64), offsets.astype(np.int64) - offsets[0]).view(np.int64)
            own = [pa.array(node, pa.int64()), pa.array(n, pa.int64()), lists, *map(pa.array, np.array(g, dtype=np.int64).reshape(-1, len(SIGNATURE) + len(PREFIX)).T), pa.array(fp)]
            yield pa.record_batch([b.column("doc_id"), b.column("text_id"), *own], names=["doc_id", "text_id", "node", "n", "s", *OWN])

    rows = hashed(docs, p.shingle)
    return rows.mapInArrow(run, rows.drop("h").schema.simpleString()[7:-1] + ", node long, n long, s array<long>, " + ", ".join(f"{g} long" for g in OWN))


def buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The rows of each value of the first column of sorted batches, where there are two or more."""
    rest = None
    for b in batches:
        now = [b.column(c).to_numpy() for c in columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        edges = np.concatenate([[0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1])
        for i, j in zip(edges[:-1], edges[1:]):
            if j - i > 1:
                yield [x[i:j] for x in now]
        # The last bucket may go on in the next batch.
        rest = [x[edges[-1] :] for x in now]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def batched(rows: Iterator[list[np.ndarray]], names: list[str], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about the given size from many small runs of rows."""
    kept, n = [], 0
    for r in rows:
        kept.append(r)
        n += len(r[0])
        if n >= size:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*kept)], names=names)
            kept, n = [], 0
    if kept:
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*kept)], names=names)


def needed(n: np.ndarray, m: np.ndarray, p: NearParams) -> np.ndarray:
    """Fewest prefix elements that sets of n and m elements share if they are similar."""
    left = np.maximum(-(-p.num * n // p.den), -(-p.num * m // p.den)) - 1
    return -(-p.num * (n + m) // (p.num + p.den)) - left


def candidates(tokens: DataFrame, p: NearParams) -> DataFrame:
    """From s, node and n: pairs of nodes (a, b) with the shared elements that they need, and members (a, of b shingles) of large buckets.

    `one` counts a shared element once for each pair of a small bucket; neighbours in a large one count none.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for s, node, n in buckets(batches, ["s", "node", "n"]):
            m = len(node)
            for k in range(1, m if m <= p.direct else 3):
                near = np.flatnonzero(p.den * n[:-k] >= p.num * n[k:])
                a, b = node[near], node[near + k]
                yield [np.zeros(len(a), np.int64), np.zeros(len(a), bool), np.minimum(a, b), np.maximum(a, b), needed(n[near], n[near + k], p), np.full(len(a), int(m <= p.direct))]
            if m > p.direct:
                yield [s, np.ones(m, bool), node, n, np.zeros(m, np.int64), np.zeros(m, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(found(batches), ["token", "large", "a", "b", "need", "one"])

    dealt = tokens.repartition("s").sortWithinPartitions("s", "n", "node")
    return dealt.mapInArrow(run, "token long, large boolean, a long, b long, need long, one long")


def compared(large: DataFrame, p: NearParams, emit) -> DataFrame:
    """emit(node, i, others, bits) for each set i of each large bucket whose sets no link joins all.

    `others` are the later sets that are apart from it and may be similar, by signature (differing in so many bits) and by
    the elements that the prefixes can share.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for token, node, n, root, *g in buckets(batches, ["token", "node", "n", "root", *SIGNATURE, *PREFIX]):
            if (root == root[0]).all():
                continue
            g, held, taken = np.stack(g[:4], axis=1).view(np.uint64), np.stack(g[4:-1], axis=1).view(np.uint64), g[-1]
            last = np.searchsorted(n, p.den * n // p.num, side="right")
            upto = np.packbits(np.arange(512) <= int(token[:1].view(np.uint64)[0] >> np.uint64(55))).view(np.uint64)
            for i in range(len(node) - 1):
                rest = slice(i + 1, last[i])
                away = np.bitwise_count(g[rest] ^ g[i]).sum(axis=1, dtype=np.int64)
                own = np.flatnonzero((root[rest] != root[i]) & (away <= p.differing))
                away, own = away[own], own + i + 1
                # Shared elements share their bits, but for those that found one taken.
                both = held[own] & held[i]
                spare = np.bitwise_count(both).sum(axis=1, dtype=np.int64) + np.minimum(taken[own], taken[i]) - needed(n[own], n[i], p)
                # A pair that shares enough has its first shared element among as many first bits as it has to spare, so
                # it is met there, and its other buckets need not give it again.
                enough = (spare >= 0) & (np.bitwise_count(both & upto).sum(axis=1, dtype=np.int64) <= spare + 1)
                if enough.any():
                    yield emit(node, i, own[enough], away[enough])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Buckets of a group hold the same pairs: a task gives each but once among many.
        for b in batched(found(batches), ["a", "b"], 500_000):
            pairs = np.unique(np.stack([b.column(c).to_numpy() for c in ("a", "b")], axis=1), axis=0)
            yield pa.record_batch([pa.array(x) for x in pairs.T], names=["a", "b"])

    return large.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(run, "a long, b long")


def nearest(large: DataFrame, p: NearParams, skipped: int) -> DataFrame:
    """Pairs (a, b) of each set of a large bucket with those that are apart from it and nearest by signature, the first `skipped` left out."""

    def emit(node, i, others, away):
        own = others[np.argsort(away, kind="stable")[skipped : skipped + p.partners]]
        return [np.minimum(node[i], node[own]), np.maximum(node[i], node[own])]

    return compared(large, p, emit).distinct()


def apart(large: DataFrame, p: NearParams) -> DataFrame:
    """All pairs (a, b) of sets of a large bucket that are still apart and may be similar."""
    return compared(large, p, lambda node, i, others, away: [np.minimum(node[i], node[others]), np.maximum(node[i], node[others])]).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) of distinct nodes whose whole sets reach the similarity, as src and dst."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = small_side(stored(nodes.join(ends, "node", "left_semi").select(F.col("low_text").alias("_id")), "needed-texts"))
    chosen = docs.join(ids, F.xxhash64("text") == F.col("_id"), "left_semi")
    full = stored(sets(chosen, np.zeros(0, np.int64), p, whole=True).dropDuplicates(["node"]).select("node", "s"), "whole-sets")
    a, b = (full.select(F.col("node").alias(f"_{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    # shared / (both - shared) >= num / den, in whole numbers.
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * (p.num + p.den) >= (F.size("sa") + F.size("sb")) * p.num).select(F.col("b").alias("src"), F.col("a").alias("dst"))


def near_fingerprints(nodes: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """Links (src, dst) between nodes whose fingerprints are the same or within `bits`, and whose whole sets reach the similarity."""
    found = edges_of(nodes.select("node", "fp0"), "fp0", SimHashParams(shingle=p.shingle, bits=p.bits))
    return verified(stored(found.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct(), "near-fingerprints"), nodes, docs, p)


def roots(edges: DataFrame, name: str) -> DataFrame:
    return stored(components(edges).select(F.col("node").alias("_node"), "root"), name)


def links(found: DataFrame, docs: DataFrame, p: NearParams) -> DataFrame:
    """src and dst: links between nodes (of rows row, text_id, node, n, s) that join all nodes that similar pairs join."""
    nodes = found.groupBy("node").agg(F.min(F.struct("row", "text_id", *OWN)).alias("_low"))
    nodes = stored(nodes.select("node", F.col("_low.row").alias("_row"), F.col("_low.text_id").alias("low_text"), *[F.col(f"_low.{g}").alias(g) for g in OWN]), "nodes")
    joined = stored(near_fingerprints(nodes, docs, p), "fingerprint-links")
    once = found.join(nodes.select("_row"), F.col("row") == F.col("_row"), "left_semi")
    met = stored(candidates(once.select(F.explode("s").alias("s"), "node", "n"), p), "candidates")
    pairs = stored(met.where("not large").groupBy("a", "b").agg(F.sum("one").alias("shared"), F.max("need").alias("need")), "pairs")
    # What a pair may share in large buckets is bounded by how many of them its nodes are in.
    often = small_side(stored(met.where("large").groupBy("a").count(), "in-large-buckets"))
    ca, cb = (often.select(F.col("a").alias(f"_{c}"), F.col("count").alias(f"_n{c}")) for c in "ab")
    bounded = pairs.join(ca, F.col("a") == F.col("_a"), "left").join(cb, F.col("b") == F.col("_b"), "left")
    likely = bounded.where(F.col("shared") + F.least(F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))) >= F.col("need"))
    # Fingerprints have joined some already.
    top = small_side(roots(joined, "roots-by-fingerprints"))
    ra, rb = (top.select(F.col("_node").alias(f"_m{c}"), F.col("root").alias(f"_r{c}")) for c in "ab")
    open_pairs = likely.select("a", "b").join(ra, F.col("a") == F.col("_ma"), "left").join(rb, F.col("b") == F.col("_mb"), "left").where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b"))
    tried = stored(open_pairs.select("a", "b"), "likely-pairs")
    joined = stored(joined.union(verified(tried, nodes, docs, p)), "links")
    large = met.where("large").select("token", F.col("a").alias("node"), F.col("b").alias("n"))
    if large.isEmpty():
        return joined
    large = stored(large.join(nodes.select("node", *SIGNATURE, *PREFIX), "node"), "large-buckets")

    def split(edges: DataFrame) -> DataFrame:
        top = small_side(roots(edges, "roots-so-far"))
        return large.join(top, F.col("node") == F.col("_node"), "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"), *SIGNATURE, *PREFIX)

    for k in range(p.rounds):
        new = stored(nearest(split(joined), p, k * p.partners).join(tried, ["a", "b"], "left_anti"), "nearest-pairs")
        if new.isEmpty():
            break
        joined, tried = stored(joined.union(verified(new, nodes, docs, p)), "links"), stored(tried.union(new), "tried-pairs")
    rest = stored(apart(split(joined), p).join(tried, ["a", "b"], "left_anti"), "pairs-apart")
    return joined.union(verified(rest, nodes, docs, p))


def groups(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """doc_id, text_id, root and component_id (the smallest doc_id that links reach) of every row."""
    docs = docs.select("doc_id", "text")
    found = stored(sets(docs, common_shingles(docs, p), p, whole=False).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    top = small_side(roots(links(found, docs, p), "roots"))
    rows = stored(found.join(top, F.col("node") == F.col("_node"), "left").select("doc_id", "text_id", F.coalesce("root", "node").alias("root")), "rows")
    named = rows.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, F.col("root") == F.col("_root")).select("doc_id", "text_id", "root", "component_id")


def representatives(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """The rows of one document of each group: the one with the smallest doc_id, and of its rows one.

    Rows with a null doc_id can't be told apart and stay.
    """
    found = stored(groups(docs, p).where("doc_id is not null").select("doc_id", "text_id", "root"), "groups")
    counts = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")).agg(F.count("*").alias("_rows"), F.first("root").alias("_root"))
    best = counts.groupBy(F.col("_root").alias("_r")).agg(F.min(F.struct("_id", "_text")).alias("_best"))
    judged = stored(counts.join(best, F.col("_root") == F.col("_r")).select("_id", "_text", "_rows", (F.struct("_id", "_text") == F.col("_best")).alias("_stays")), "judged")
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_text"))
    gone = small_side(stored(judged.where("not _stays").select("_id", "_text"), "duplicates"))
    kept = keyed.join(gone, same, "left_anti")
    repeated = stored(judged.where("_rows > 1 and _stays").select("_id", "_text"), "repeated-rows")
    if repeated.isEmpty():
        return kept.drop("_key")
    repeated = small_side(repeated)
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_key"])
    return kept.join(repeated, same, "left_anti").unionByName(once).drop("_key")
