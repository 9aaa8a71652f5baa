"""Terms that come in the same sections: counts of the pairs that can reach a share of the rarer term's sections, by blocks of sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

#: Terms of sections that a block holds (it ends with the batch that reaches them), and pairs and first terms that are looked at at a time.
TOKENS, PAIRS, FIRST = 1 << 21, 1 << 22, 8192
#: A term's companions are counted by so many hashes first (a power of two).
COUNTERS = 256


def _ints(x) -> np.ndarray:
    return (x.values if isinstance(x, pa.Scalar) else x).to_numpy(zero_copy_only=False)


def _row(**columns) -> pa.RecordBatch:
    """One row: numbers as they are, arrays as lists."""
    held = [pa.array([x]) if isinstance(x, (int, bytes)) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in columns.values()]
    return pa.RecordBatch.from_arrays(held, names=list(columns))


def _zipped(x: np.ndarray, rising: bool = True) -> bytes:
    """Whole numbers (if they mostly rise, what each adds to the one before): bytes of one place after those of another."""
    x = x.astype("<i8")
    planes = (np.diff(x, prepend=0) if rising else x).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unzipped(x: pa.Scalar, n: int, rising: bool = True) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x.as_py(), 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    found = np.ascontiguousarray(planes.T).reshape(-1).view("<i8")
    return np.cumsum(found) if rising else found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i] for c in b.schema.names}


def _block(found: list[pa.Array]) -> pa.RecordBatch:
    """Sections by the block's own numbers of terms; equal ones are one with their number."""
    whole = pa.concat_arrays(found)
    coded = whole.flatten().dictionary_encode()
    sizes = _ints(whole.value_lengths()).astype(np.int64)
    rows, codes = np.repeat(np.arange(len(sizes)), sizes), _ints(coded.indices).astype(np.int32)
    codes = codes[np.lexsort((codes, rows))]
    raw, ends, seen = codes.tobytes(), np.cumsum(sizes) * 4, {}
    which = np.fromiter((seen.setdefault(raw[z - 4 * n : z], len(seen)) for n, z in zip(sizes.tolist(), ends.tolist())), np.int64, len(sizes))
    _, first = np.unique(which, return_index=True)
    n, kept = np.bincount(which), np.zeros(len(sizes), bool)
    kept[first] = True
    codes, sizes = codes[kept[rows]], sizes[kept]
    held = np.bincount(codes, np.repeat(n, sizes), len(coded.dictionary)).astype(np.int64)
    return _row(known=int(n.sum()), n=n.astype(np.int64), sizes=sizes.astype(np.int32), codes=_zipped(codes), terms=coded.dictionary, held=held)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, size = [], 0
    for b in batches:
        if b.num_rows:
            found.append(b.column("terms"))
            size += len(found[-1].flatten())
        if size >= TOKENS:
            yield _block(found)
            found, size = [], 0
    if found:
        yield _block(found)


def _trimmed(x: dict, section_terms: int, most: float) -> Iterator[pa.RecordBatch]:
    """Sections of known terms, the rarest first and `section_terms` at most, without those in more than `most` sections, if two or more are left."""
    n, sizes, pos, ids, dfs = (_ints(x[c]) for c in ("n", "sizes", "pos", "ids", "dfs"))
    codes, order = _unzipped(x["codes"], int(sizes.sum())), np.argsort(ids)
    ids, dfs, place = ids[order], dfs[order], np.full(int(max(codes.max(), pos.max())) + 1, -1)
    place[pos[order]] = np.arange(len(ids))
    rows, codes = np.repeat(np.arange(len(sizes)), sizes), place[codes]
    rows, codes = rows[codes >= 0], codes[codes >= 0]
    codes = codes[np.lexsort((codes, rows))]
    sizes = np.bincount(rows, minlength=len(n))
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = (rank < section_terms) & (dfs[codes] <= most)
    rows, codes = rows[kept], codes[kept]
    sizes = np.bincount(rows, minlength=len(n))
    used, codes = np.unique(codes[sizes[rows] >= 2], return_inverse=True)
    if len(used):
        yield _row(block=x["block"].as_py(), n=n[sizes >= 2], sizes=sizes[sizes >= 2].astype(np.int32), codes=_zipped(codes), ids=ids[used], dfs=dfs[used])


class _Pairs:
    """The pairs of a block's sections, by their rarer term."""

    def __init__(self, x: dict):
        self.n, sizes, self.ids, self.dfs = (_ints(x[c]) for c in ("n", "sizes", "ids", "dfs"))
        self.codes = _unzipped(x["codes"], int(sizes.sum()))
        self.hashed = ((self.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)[self.codes]
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.cumsum(sizes, dtype=np.int64)[self.rows] - np.arange(len(self.rows)) - 1  # a section's terms after this one are its partners
        self.order = np.argsort(self.codes, kind="stable")

    def taken(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For some of the wanted terms at a time: these; their places in sections, how many partners each has there and its term's place among them; the pairs' partners, in that order."""
        many = np.bincount(self.codes, self.left, len(self.ids))
        first = np.searchsorted(self.codes[self.order], np.arange(len(self.ids) + 1))
        wanted = wanted[many[wanted] > 0]
        ends, lo = np.cumsum(many[wanted]), 0
        while lo < len(wanted):
            hi = max(lo + 1, min(lo + FIRST, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right"))))
            own = wanted[lo:hi]
            size = first[own + 1] - first[own]
            at = self.order[np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            left = self.left[at]
            second = np.repeat(at + 1 - (np.cumsum(left) - left), left) + np.arange(left.sum())
            yield own, at, left, np.repeat(np.arange(len(own)), size), second
            lo = hi


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return ids % 1_000_003 % parts


def _counted(x: dict, parts: int) -> Iterator[pa.RecordBatch]:
    """What a block adds to the counters of its terms, by part of the terms: the counters' bytes, the lowest of all first."""
    pairs, block = _Pairs(x), x["block"].as_py()
    for own, at, left, place, second in pairs.taken(np.arange(len(pairs.ids))):
        counter, more = np.repeat(place * COUNTERS, left) + pairs.hashed[second], pairs.n[pairs.rows[at]] - 1
        held = np.bincount(counter, minlength=len(own) * COUNTERS)
        if more.any():  # sections that stand for several
            held = held + np.bincount(counter[np.repeat(more > 0, left)], np.repeat(more[more > 0], left[more > 0]), len(held))
        held = held.astype("<i8").reshape(len(own), COUNTERS)
        part = _part(pairs.ids[own], parts)
        for p in np.unique(part):
            mine = part == p
            width = max(1, -(-int(held[mine].max()).bit_length() // 8))
            planes = np.ascontiguousarray(held[mine]).view(np.uint8).reshape(-1, 8)[:, :width].T
            data = pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)
            yield _row(part=int(p), block=block, width=width, codes=own[mine].astype(np.int32), ids=pairs.ids[own[mine]], dfs=pairs.dfs[own[mine]], data=data)


def _passed(table: pa.Table, least: int, containment: float) -> pa.Table:
    """For each block the terms of a part that have counters which a pair of enough sections can be in, and which ones these are."""
    rows = list(_rows(table.to_batches()))
    ids, at = np.unique(np.concatenate([_ints(r["ids"]) for r in rows]), return_index=True)
    dfs, total = np.concatenate([_ints(r["dfs"]) for r in rows])[at], np.zeros((len(ids), COUNTERS), np.int64)
    for r in rows:
        k, width = len(r["codes"].values), r["width"].as_py()
        planes = np.frombuffer(pa.decompress(r["data"].as_py(), k * COUNTERS * width, codec="zstd"), np.uint8).reshape(width, -1)
        held = np.zeros((k * COUNTERS, 8), np.uint8)
        held[:, :width] = planes.T
        total[np.searchsorted(ids, _ints(r["ids"]))] += held.reshape(-1).view("<i8").reshape(k, COUNTERS)
    passed = np.packbits((total >= least) & (total >= containment * dfs[:, None] - 1e-9), axis=1)
    some = passed.any(axis=1)
    found = []
    for r in rows:
        at = np.searchsorted(ids, _ints(r["ids"]))
        codes, bits = _ints(r["codes"])[some[at]], passed[at[some[at]]]
        found.append(_row(block=r["block"].as_py(), codes=codes.astype(np.int32), bits=pa.compress(bits.tobytes(), codec="zstd", asbytes=True)))
    return pa.Table.from_batches(found)


def _left(x: dict, parts: int) -> Iterator[pa.RecordBatch]:
    """Of a block, each pair whose counter has passed, and its number of sections, by part of the first terms."""
    pairs = _Pairs(x)
    passed = np.zeros((len(pairs.ids), COUNTERS // 8), np.uint8)
    for codes, bits in zip(x["passed"].values.field("codes"), x["passed"].values.field("bits")):
        k = len(codes.values)
        if k:
            passed[_ints(codes)] = np.frombuffer(pa.decompress(bits.as_py(), k * COUNTERS // 8, codec="zstd"), np.uint8).reshape(k, -1)
    for own, at, left, place, second in pairs.taken(np.flatnonzero(passed.any(axis=1))):
        kept = np.flatnonzero(np.unpackbits(passed[own], axis=1).reshape(-1)[np.repeat(place * COUNTERS, left) + pairs.hashed[second]])
        token = np.searchsorted(np.cumsum(left), kept, "right")
        key, n = place[token] * len(pairs.ids) + pairs.codes[second[kept]], pairs.n[pairs.rows[at[token]]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        a, b = np.divmod(key[first], len(pairs.ids))
        c, part = np.add.reduceat(n[order], first) if len(first) else n, _part(pairs.ids[own], parts)
        for p in np.unique(part[a]):
            mine = part[a] == p
            terms, sizes = np.unique(a[mine], return_counts=True)
            terms = own[terms]
            yield _row(part=int(p), ids=pairs.ids[terms], dfs=pairs.dfs[terms], sizes=sizes.astype(np.int32), seconds=_zipped(pairs.ids[b[mine]]), counts=_zipped(c[mine], False))


def _summed(table: pa.Table, least: int, containment: float) -> pa.Table:
    """A part's pairs that are in enough sections."""
    a, b, da, c = [], [], [], []
    for r in _rows(table.to_batches()):
        sizes = _ints(r["sizes"])
        a.append(np.repeat(_ints(r["ids"]), sizes))
        da.append(np.repeat(_ints(r["dfs"]), sizes))
        b.append(_unzipped(r["seconds"], int(sizes.sum())))
        c.append(_unzipped(r["counts"], int(sizes.sum()), False))
    a, b, da, c = (np.concatenate(x) for x in (a, b, da, c))
    order = np.lexsort((b, a))
    a, b, da, c = a[order], b[order], da[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]))
    a, b, da, c = a[first], b[first], da[first], np.add.reduceat(c, first)
    kept = (c >= least) & (c >= containment * da)
    return pa.table({"a": a[kept], "b": b[kept], "da": da[kept], "c": c[kept]})


def companions(sections: DataFrame, least: int, containment: float, section_terms: int, most_common: float) -> tuple[DataFrame, DataFrame, int]:
    """Pairs (a, b, da, c) of numbered terms in c sections together, a in da of them, numbered terms (t, term, df), and the number of sections.

    sections: terms, an array of different ones, two or more. A section counts by its rarest `section_terms` of the terms in `least` sections or more;
    terms in more than `most_common` of the sections make no pairs. The pairs are all with c of at least `least` and `containment` of the sections
    of a, the rarer term. Sections stay in blocks: a term's companions are first counted by
    hashes, block by block, and only pairs whose counter reaches what the pair would need are counted one by one.
    """
    packed = sections.select("terms").mapInArrow(_packed, "known long, n array<long>, sizes array<int>, codes binary, terms array<string>, held array<long>")
    packed = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    total = packed.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    terms = packed.select("block", F.posexplode(F.arrays_zip("terms", "held")).alias("pos", "x")).select("block", "pos", F.col("x.terms").alias("term"), F.col("x.held").alias("held"))
    # Numbers follow the order by rarity, so sections can be sorted by them.
    df = cut(terms.groupBy("term").agg(F.sum("held").alias("df")).where(F.col("df") >= least).orderBy("df", "term").withColumn("t", F.monotonically_increasing_id()))
    numbered = F.sort_array(F.collect_list(F.struct("pos", "t", "df")))
    known = terms.select("block", "pos", "term").join(df, "term").groupBy(F.col("block").alias("_b")).agg(numbered.alias("_t"))
    met = packed.join(known, F.col("block") == F.col("_b")).select("block", "n", "sizes", "codes", F.col("_t.pos").alias("pos"), F.col("_t.t").alias("ids"), F.col("_t.df").alias("dfs"))
    kind, most = "block long, n array<long>, sizes array<int>, codes binary, ids array<long>, dfs array<long>", most_common * total
    blocks = cut(met.mapInArrow(lambda batches: (r for x in _rows(batches) for r in _trimmed(x, section_terms, most)), kind))
    parts = max(16, df.count() // 16384 + 1, packed.count())
    counted = blocks.mapInArrow(lambda batches: (r for x in _rows(batches) for r in _counted(x, parts)), "part long, block long, width long, codes array<int>, ids array<long>, dfs array<long>, data binary")
    passed = counted.groupBy("part").applyInArrow(lambda t: _passed(t, least, containment), "block long, codes array<int>, bits binary")
    wanted = passed.groupBy(F.col("block").alias("_b")).agg(F.collect_list(F.struct("codes", "bits")).alias("passed"))
    left = blocks.join(wanted, F.col("block") == F.col("_b")).drop("_b").mapInArrow(lambda batches: (r for x in _rows(batches) for r in _left(x, parts)), "part long, ids array<long>, dfs array<long>, sizes array<int>, seconds binary, counts binary")
    return left.groupBy("part").applyInArrow(lambda t: _summed(t, least, containment), "a long, b long, da long, c long"), df, total
