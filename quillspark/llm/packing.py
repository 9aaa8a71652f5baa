"""Packing of tokenized documents into sequences of a fixed length, by dominance reduction and best fit.

Spark tokenizes the texts, cuts longer documents into pieces and counts the pieces of each length. Lengths are whole
numbers up to the sequence length, so these counts (at most `size` numbers, whatever the corpus) describe the
instance. The Martello-Toth reduction fixes small sets of pieces that provably dominate all alternatives, best fit
decreasing packs the rest, and the plan deals Spark's numbering of the pieces of each length to sequences.

Defined results: a null text counts as empty, which is one piece of the end token alone; repeated rows are packed
each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrow_words import numbered, runs, split
from quillspark.llm.common import ranked, stored

#: Words of letters that lower-casing and composition leave one for one, then ASCII marks other than apostrophe and
#: underscore: the tokenizer splits such a word into its letters and its marks.
PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-\\^`{-~]*)$"


@dataclass(frozen=True)
class PackParams:
    """`cache` bounds the words whose ids a worker remembers, `run_bytes` the text that it handles at once (one text at least)."""

    vocabulary: str = ""
    size: int = 4096
    end: int = 1
    cache: int = 600_000
    run_bytes: int = 4 << 20
    blocks: int = 256
    block_rows: int = 100_000


class Sequences:
    """Token ids of strings, end to end in one array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.string())
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, names: pa.Array) -> np.ndarray:
        """The place of each name, -1 if it is not here."""
        return pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def add(self, names: pa.Array, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Append names with the ids of each; gives their places."""
        first = len(self.size)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.names, self.size, self.ids = pa.concat_arrays([self.names, names]), np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        return np.arange(first, len(self.size))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the names at these places, end to end, and how many each has."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


class WordIds:
    """Token ids of texts by their white-space separated words: the tokenizer drops white space."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.parts = Tokenizer.from_file(path), limit, Sequences(), Sequences()

    def encode(self, names: pa.Array, single: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of strings; `single` says that each is one pre-token, so that pre-token numbers tell them apart."""
        sizes, ids, strings = [], [], names.to_pylist()
        # Short joined texts encode fastest.
        for at in range(0, len(strings), 200):
            own = strings[at : at + 200]
            found = self.tokenizer.encode("\n".join(own), add_special_tokens=False)
            if single:
                place = np.array(found.word_ids, dtype=np.int64)
            else:
                starts = np.cumsum([0] + [len(s) + 1 for s in own])
                place = np.searchsorted(starts, np.array([o[0] for o in found.offsets], dtype=np.int64), side="right") - 1
            sizes.append(np.diff(np.searchsorted(place, np.arange(len(own) + 1))))
            ids.append(np.array(found.ids, dtype="<u4"))
        return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, "<u4"), *ids])

    def learn(self, words: pa.Array) -> np.ndarray:
        """Tokenize unknown words: plain ones by their letters and the marks behind them, others whole."""
        split_up = pc.extract_regex(words, PLAIN)
        plain = split_up.is_valid().to_numpy(zero_copy_only=False)
        own = split_up.filter(pa.array(plain))
        place, parts = numbered(pa.concat_arrays([pc.utf8_lower(own.field("letters")), own.field("marks")]))
        if len(self.parts.size) + len(parts) > self.limit:
            self.parts.clear()
        at = self.parts.find(parts)
        empty = pc.equal(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False) & (at < 0)
        at[empty] = self.parts.add(parts.filter(pa.array(empty)), np.zeros(empty.sum(), np.int64), np.zeros(0, "<u4"))
        new = at < 0
        missing = parts.filter(pa.array(new))
        at[new] = self.parts.add(missing, *self.encode(missing, single=True))
        pairs = at[place].reshape(2, -1).T.ravel()
        ids, size = self.parts.gather(pairs)
        out = np.empty(len(words), dtype=np.int64)
        out[plain] = self.known.add(words.filter(pa.array(plain)), size.reshape(-1, 2).sum(axis=1), ids)
        other = words.filter(pa.array(~plain))
        out[~plain] = self.known.add(other, *self.encode(other, single=False))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, end to end, and how many each has."""
        words, lengths = split(texts)
        place, distinct = numbered(words)
        at = self.known.find(distinct)
        new = at < 0
        if len(self.known.size) + new.sum() > self.limit:
            self.known.clear()
            new[:] = True
        if new.any():
            at[new] = self.learn(distinct.filter(pa.array(new)))
        ids, size = self.known.gather(at[place])
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])])


_WORD_IDS: dict[tuple, WordIds] = {}


def word_ids(p: PackParams) -> WordIds:
    """A worker's tokenizer, with the words that it remembers from other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (p.vocabulary, p.cache) not in _WORD_IDS:
        _WORD_IDS.clear()
        _WORD_IDS[p.vocabulary, p.cache] = WordIds(p.vocabulary, p.cache)
    return _WORD_IDS[p.vocabulary, p.cache]


def pieces(docs: DataFrame, p: PackParams) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(p)
        for b in batches:
            for first, texts in runs(b.column("text"), p.run_bytes):
                flat, size = ids(texts)
                flat, size = np.insert(flat, np.cumsum(size), p.end), size + 1
                n = -(-size // p.size)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(size[row] - piece * p.size, p.size)
                ends = np.cumsum(length)
                data = memoryview(np.ascontiguousarray(flat)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip((ends - length).tolist(), ends.tolist())]
                yield pa.record_batch(
                    [b.column("doc_id").take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(piece * p.size), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Bins of like content: (first bin, number of bins, lengths of the pieces in each, in order)."""

    bins: int = 0
    patterns: list[tuple[int, int, tuple[int, ...]]] = field(default_factory=list)

    def add(self, n: int, lengths: tuple[int, ...]) -> None:
        self.patterns.append((self.bins, n, lengths))
        self.bins += n


class Counts:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.order.remove(length)

    def largest(self, most: int, besides: tuple[int, ...] = ()) -> int | None:
        """The largest length up to `most` of which a piece is left besides the given ones."""
        for k in range(bisect_right(self.order, most) - 1, -1, -1):
            if self.n[self.order[k]] > besides.count(self.order[k]):
                return self.order[k]
        return None

    def smallest(self, n: int, besides: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for length in self.order:
            out += [length] * min(n - len(out), self.n[length] - besides.count(length))
            if len(out) >= n:
                break
        return out


def dominating(left: Counts, length: int, size: int) -> tuple[int, ...] | None:
    """A set with the largest piece that dominates every other feasible set with it, or None if none is proven."""
    room = size - length
    one = left.largest(room, (length,))
    if one is None:
        return (length,)
    # An exact fill by one piece: what any other set adds sums up to no more than that piece.
    if one == room:
        return (length, one)
    low = left.smallest(3, (length,))
    # No two more pieces fit: the largest that fits replaces any other.
    if len(low) < 2 or low[0] + low[1] > room:
        return (length, one)
    if len(low) == 3 and sum(low) <= room:
        return None
    # At most two more fit. With the largest first, no other pair may have a larger second piece.
    two = left.largest(room - one, (length, one))
    if two is None:
        # `one` fills alone: it replaces a pair only if it is as large as any fitting pair together.
        return None
    second = left.largest(room // 2, (length,))
    while second is not None and left.largest(room - second, (length, second)) in (None, *[x for x in left.order if x < second]):
        second = left.largest(second - 1, (length,))
    return (length, one, two) if second is None or second <= two else None


def pack(counts: dict[int, int], size: int) -> Plan:
    """Reduce, then best fit decreasing; like pieces are placed together."""
    plan, left, rest = Plan(), Counts(counts), {}
    while left.order:
        length = left.order[-1]
        found = dominating(left, length, size)
        if found is None:
            rest[length] = left.n[length]
            left.take(length, left.n[length])
            continue
        used = {x: found.count(x) for x in found}
        n = min(left.n[x] // c for x, c in used.items())
        plan.add(n, found)
        for x, c in used.items():
            left.take(x, n * c)
    # Open bins by room left: for each room the (number of bins, lengths) that have it.
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    order: list[int] = []

    def put(room: int, n: int, lengths: tuple[int, ...]) -> None:
        if room not in rooms or not rooms[room]:
            order.insert(bisect_right(order, room), room)
        rooms[room].append((n, lengths))

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            k = bisect_right(order, length - 1)
            if k < len(order):
                room = order[k]
                bins, lengths = rooms[room].pop()
                if not rooms[room]:
                    order.pop(k)
            else:
                room, bins, lengths = size, max(1, n // (size // length)), ()
            each = min(room // length, max(1, n // bins))
            own = min(bins, n // each)
            if lengths and own < bins:
                put(room, bins - own, lengths)
            put(room - each * length, own, lengths + (length,) * each)
            n -= own * each
    for room in order:
        for n, lengths in rooms[room]:
            plan.add(n, lengths)
    return plan


def assign(numbered: DataFrame, plan: Plan) -> DataFrame:
    """Add sequence_id and offset to pieces with `length` and `rank` (their number within that length)."""
    next_rank: dict[int, int] = defaultdict(int)
    runs = []
    for first, n, lengths in plan.patterns:
        at = 0
        for x in lengths:
            runs.append((x, next_rank[x], first, at))
            next_rank[x] += n
            at += x
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            own = table[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1] if len(table) else table
            b = b.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])], names=[*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("rank").schema)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, p: PackParams) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = stored(pieces(docs, p), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    # Blocks of at most about `block_rows` pieces, so that a length that many pieces have is numbered by many tasks.
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(p.blocks, max(counts.values(), default=0) // p.block_rows)))
    numbered = ranked(cut, ["length"], ["doc_id", "piece"], block).withColumn("rank", F.col("rank").cast("long"))
    return assign(numbered.select(*cut.columns, "rank"), pack(counts, p.size))
