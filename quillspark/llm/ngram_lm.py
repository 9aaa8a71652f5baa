"""A smoothed n-gram model in Elias-Fano tries on the shared folder, memory-mapped by the tasks that score.

Spark counts words and word pairs over all training texts and sorts them by ranges; each task writes its range as one
shard. A shard of the first level holds the words' 64-bit hashes as a monotone Elias-Fano sequence with their exact
counts. A shard of the second level holds its contexts, monotone pointers to their successors, and the successors'
numbers made monotone over contexts, all Elias-Fano coded, with probabilities quantised to 8 bits. A pair is found by
successor search relative to its context's start. Shards are written under a name of their own and named by the
table that the writing job returns, so repeated or lost tasks do no harm.

The model interpolates absolutely discounted pairs with add-one word probabilities; the first word's context is the
start of the text. Two levels are built: three would take more disk than the check tool's limit (see the README).

Defined results: a null or empty text is its end token alone; repeated rows count each time; a null doc_id trains;
with no training text N and V are zero and every score is zero-based add-one (log10 of 1). Extra columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrow_words import Known, numbered, runs, split
from quillspark.llm.common import new_folder, stored

#: The end of a text: white space, so no word of any text.
END = b"\n"
#: The lower half of a pair: its word's number. The upper half is its context, V + 1 for the start of a text.
WORD = (1 << 31) - 1


@dataclass(frozen=True)
class LmParams:
    discount: float = 0.75
    shard_rows: int = 1_000_000
    cache: int = 400_000
    run_bytes: int = 4 << 20


class EliasFano:
    """A monotone sequence of n numbers below 2^63: unary high bits with a directory, packed low bits."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, low_bits: int):
        self.n, self.l = n, low_bits
        self.high, self.ones, self.zeros, self.low = (arrays[k] for k in ("high", "ones", "zeros", "low"))

    @staticmethod
    def build(x: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
        n = len(x)
        top = int(x[-1]) if n else 0
        low_bits = max(0, int(np.floor(np.log2(max(1, top) / max(1, n)))))
        high = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        words = np.zeros((int(high[-1]) if n else 0) // 64 + 2, dtype=np.uint64)
        np.bitwise_or.at(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
        # ones and zeros: such bits before each 64-bit word.
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32)
        zeros = (64 * np.arange(len(ones)) - ones).astype(np.uint32)
        low = np.zeros(n * low_bits // 64 + 2, dtype=np.uint64)
        if low_bits:
            value = x & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, value << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, value[over] >> (np.uint64(64) - shift[over]))
        return {"high": words, "ones": ones, "zeros": zeros, "low": low}, n, low_bits

    def _in_word(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) set bit of each word."""
        at = np.zeros(len(word), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = k >= below
            k = np.where(up, k - below, k)
            word = np.where(up, word >> np.uint64(half), word)
            at += np.where(up, half, 0)
        return at

    def select1(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th set bit."""
        w = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        return 64 * w + self._in_word(self.high[w], i - self.ones[w].astype(np.int64))

    def select0(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th zero."""
        w = np.searchsorted(self.zeros, i.astype(np.uint32), side="right") - 1
        return 64 * w + self._in_word(~self.high[w], i - self.zeros[w].astype(np.int64))

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.int64) * self.l
        shift = (at & 63).astype(np.uint64)
        value = self.low[at >> 6] >> shift
        over = (at & 63) + self.l > 64
        value[over] |= self.low[(at[over] >> 6) + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.select1(i) - i).astype(np.uint64) << np.uint64(self.l)) | self.low_of(i)

    def successor(self, q: np.ndarray) -> np.ndarray:
        """Place of the first number that is at least q (n if there is none)."""
        if not self.n:
            return np.zeros(len(q), dtype=np.int64)
        high = (q >> np.uint64(self.l)).astype(np.int64)
        most = int(self.select1(np.array([self.n - 1]))[0]) - (self.n - 1)
        inside = np.minimum(high, most)
        # Numbers with this high part lie between two zeros.
        lo = np.where(inside > 0, self.select0(np.maximum(inside - 1, 0)) - inside + 1, 0)
        end = np.where(inside < most, self.select0(np.minimum(inside, max(most - 1, 0))) - inside, self.n)
        hi, want = end.copy(), q & np.uint64((1 << self.l) - 1)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, self.n - 1)
            less = (self.low_of(mid) < want) & (lo < hi)
            hi = np.where((lo < hi) & ~less, mid, hi)
            lo = np.where(less, mid + 1, lo)
        return np.where(high > most, self.n, lo)


def _open(uri: str):
    """The file system of a path in the shared folder, and the path there."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_shard(folder: str, parts: dict[str, np.ndarray]) -> str:
    """One file: a header of (name, kind, count) lines, then the arrays, each at a multiple of 8 bytes."""
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.trie"
    head = "".join(f"{k} {v.dtype.str} {len(v)}\n" for k, v in parts.items()).encode()
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8))
        for v in parts.values():
            out.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
    return f"{folder}/{name}"


_MAPPED: dict[str, dict[str, np.ndarray]] = {}


def read_shard(uri: str) -> dict[str, np.ndarray]:
    """Map a shard of the model in use; one in a remote store goes through a file that is unlinked once it is mapped."""
    if uri not in _MAPPED:
        folder = uri.rsplit("/", 1)[0] + "/"
        for other in [k for k in _MAPPED if not k.startswith(folder)]:
            del _MAPPED[other]
        store, path = _open(uri)
        copied = store.type_name != "local"
        if copied:
            import tempfile

            handle, local = tempfile.mkstemp(suffix=".trie")
            with store.open_input_stream(path) as source, os.fdopen(handle, "wb") as out:
                while chunk := source.read(1 << 24):
                    out.write(chunk)
            path = local
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if copied:
            os.unlink(path)  # the mapping keeps it for as long as the worker needs it
        size = int.from_bytes(view[:8], "little")
        at, parts = 8 + size + -size % 8, {}
        for line in view[8 : 8 + size].decode().splitlines():
            name, kind, n = line.split()
            parts[name] = np.frombuffer(view, dtype=kind, count=int(n), offset=at)
            at += parts[name].nbytes + -parts[name].nbytes % 8
        _MAPPED[uri] = parts
    return _MAPPED[uri]


def _coded(prefix: str, x: np.ndarray) -> dict[str, np.ndarray]:
    arrays, n, low_bits = EliasFano.build(x.astype(np.uint64))
    return {**{f"{prefix}.{k}": v for k, v in arrays.items()}, f"{prefix}.meta": np.array([n, low_bits], dtype=np.int64)}


def _sequence(parts: dict[str, np.ndarray], prefix: str) -> EliasFano:
    n, low_bits = (int(v) for v in parts[f"{prefix}.meta"])
    return EliasFano({k: parts[f"{prefix}.{k}"] for k in ("high", "ones", "zeros", "low")}, n, low_bits)


def hash_words(found: list[bytes]) -> np.ndarray:
    """63-bit hashes, so that they are numbers of one sign everywhere."""
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in found), dtype=np.int64, count=len(found))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words with ASCII letters lower-cased, without end tokens, and how many each text has."""
    return split(pc.ascii_lower(texts))


def with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Put the end token's value behind each text's own values."""
    return np.insert(values, np.cumsum(lengths), end)


class Level:
    """A sorted level in several shards, found by the first key of each."""

    def __init__(self, shards: list[dict]):
        self.shards = sorted(shards, key=lambda s: s["first"])
        self.firsts = np.array([s["first"] for s in self.shards], dtype=np.int64)

    def ranges(self, keys: np.ndarray) -> Iterator[tuple[dict, slice]]:
        """The shards that sorted keys fall into."""
        cuts = np.searchsorted(keys, self.firsts)
        for s, a, b in zip(self.shards, cuts, [*cuts[1:], len(keys)]):
            if b > a:
                yield s, slice(int(a), int(b))


class Model:
    """The trie as its table of shards describes it; small enough to go to every task."""

    def __init__(self, words: list[dict], pairs: list[dict], p: LmParams, name: str):
        self.name, offset = name, 0
        for s in sorted(words, key=lambda s: s["first"]):
            s["offset"] = offset
            offset += s["n"]
        self.words, self.pairs, self.p = Level(words), Level(pairs), p
        self.v = offset
        if offset + 2 > WORD:
            raise ValueError("more words than a pair's 31 bits can number")
        self.total = sum(s["total"] for s in words)
        self.end = int(self.lookup(hash_words([END]))[0][0])

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word (V if it is unknown) and its count; hashes must be sorted."""
        ids, counts = np.full(len(hashes), self.v, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for s, own in self.words.ranges(hashes):
            parts = read_shard(s["path"])
            seq, q = _sequence(parts, "hash"), (hashes[own] - s["first"]).astype(np.uint64)
            at = seq.successor(q)
            near = np.minimum(at, seq.n - 1)
            hit = (at < seq.n) & (seq.access(near) == q)
            ids[own] = np.where(hit, s["offset"] + near, self.v)
            counts[own] = np.where(hit, parts["count"][near], 0)
        return ids, counts

    def word_prob(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.v + 1)

    def pair_logs(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probabilities of sorted, distinct pairs context * 2^31 + word, given the words' counts."""
        word = keys & WORD
        weight, out = np.ones(len(keys)), np.full(len(keys), np.nan)
        for s, own in self.pairs.ranges(keys):
            parts = read_shard(s["path"])
            contexts, pointers, bases, successors = (_sequence(parts, k) for k in ("context", "pointer", "base", "successor"))
            # Each distinct context is searched once, its pairs relative to its start.
            context = keys[own] >> 31
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            size = np.diff([*first, len(context)])
            each = context[first]
            c = np.maximum(each - (s["first"] >> 31), 0).astype(np.uint64)
            at = contexts.successor(c)
            near = np.minimum(at, contexts.n - 1)
            known = (at < contexts.n) & (contexts.access(near) == c) & (each >= s["first"] >> 31)
            weight[own] = np.repeat(np.where(known, parts["backoff"][near], 1.0), size)
            low, high, stop = (np.repeat(x, size) for x in (bases.access(near), bases.access(near + 1), pointers.access(near + 1).astype(np.int64)))
            # Successors of a context are its words' numbers above the context's base, up to the next base.
            q = low + word[own].astype(np.uint64)
            place = successors.successor(q)
            inside = np.repeat(known, size) & (place < stop) & (q < high)
            place = np.minimum(place, successors.n - 1)
            inside &= successors.access(place) == q
            out[own] = np.where(inside, parts["levels"][parts["prob"][place]], np.nan)
        rest = np.isnan(out)
        out[rest] = np.log10(weight[rest] * self.word_prob(counts[rest]))
        return out


def _shards(df: DataFrame, write, name: str) -> list[dict]:
    """Run the writer over a sorted frame and collect its shards' descriptions, a few numbers for each."""
    return [r.asDict() for r in stored(df.mapInArrow(write, "first long, last long, n long, total long, path string"), name).collect()]


def count_words(docs: DataFrame, p: LmParams) -> DataFrame:
    """hash and n of every word of the texts, end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(p.cache)
        for b in batches:
            for _, texts in runs(b.column("text"), p.run_bytes):
                words, _ = tokens(texts)
                place, distinct = numbered(words)
                h = np.append(known(distinct, hash_words), hash_words([END]))
                n = np.append(np.bincount(place, minlength=len(distinct)), len(texts))
                yield pa.record_batch([pa.array(h), pa.array(n)], names=["hash", "n"])

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def word_shards(counts: DataFrame, folder: str, p: LmParams) -> list[dict]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("hash").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if got:
            h, n = (np.concatenate(x) for x in zip(*got))
            path = write_shard(folder, {**_coded("hash", h - h[0]), "count": n})
            yield pa.record_batch([pa.array([h[0]]), pa.array([h[-1]]), pa.array([len(h)]), pa.array([int(n.sum())]), pa.array([path])], names=["first", "last", "n", "total", "path"])

    shards = max(1, counts.count() // p.shard_rows)
    return _shards(counts.repartitionByRange(shards, "hash").sortWithinPartitions("hash"), write, "word-shards")


_NUMBERS: dict[str, Known] = {}


def numbers(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the texts, an end token behind each (V: unknown), and the texts' lengths in tokens.

    What a worker has looked up it remembers for the model's other tasks, up to `cache` words.
    """
    if model.name not in _NUMBERS:
        _NUMBERS.clear()
        _NUMBERS[model.name] = Known(model.p.cache)

    def look_up(found: list[bytes]) -> np.ndarray:
        h = hash_words(found)
        order = np.argsort(h)
        out = np.empty_like(h)
        out[order] = model.lookup(h[order])[0]
        return out

    words, lengths = tokens(texts)
    place, distinct = numbered(words)
    ids = _NUMBERS[model.name](distinct, look_up)
    return with_ends(ids[place], lengths, int(look_up([END])[0])), lengths + 1


def pairs_of(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Context * 2^31 + word for every token; a text's first context is the start."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return before * (1 << 31) + ids


def hot_contexts(counts: DataFrame, model: Model) -> dict[int, int]:
    """Contexts with more successors than a shard has rows, and how many: no more of them than there are shards."""
    p = model.p
    often = [model.v + 1]
    for s in model.words.shards:
        often += (s["offset"] + np.flatnonzero(read_shard(s["path"])["count"] > p.shard_rows)).tolist()
    found = counts.where(F.shiftright("key", 31).isin(often)).groupBy(F.shiftright("key", 31).alias("context")).agg(F.count("*").alias("n"))
    return {r["context"]: r["n"] for r in found.where(F.col("n") > p.shard_rows).collect()}


def pair_shards(docs: DataFrame, model: Model, folder: str) -> list[dict]:
    p = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in runs(b.column("text"), p.run_bytes):
                key, n = np.unique(pairs_of(*numbers(model, texts), model.v + 1), return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    counts = stored(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    rows = counts.count()
    hot = hot_contexts(counts, model)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, n = (np.concatenate(x) for x in zip(*got))
        context, word = key >> 31, key & WORD
        own, begin = np.unique(context, return_index=True)
        size = np.diff([*begin, len(key)])
        kinds = np.array([hot.get(c, k) for c, k in zip(own.tolist(), size.tolist())])
        # A word is a context as often as it occurs, the start as often as there are texts, that is, ends.
        total = word_counts(model, np.where(own > model.v, model.end, own))
        backoff = p.discount * kinds / total
        prob = np.log10(np.maximum(n - p.discount, 0) / np.repeat(total, size) + np.repeat(backoff, size) * model.word_prob(word_counts(model, word)))
        # 256 levels, each the mean of a run of equally many probabilities.
        order = np.argsort(prob, kind="stable")
        level = np.empty(len(prob), dtype=np.uint8)
        level[order] = np.arange(len(prob)) * 256 // len(prob)
        sums, members = np.bincount(level, prob, 256), np.bincount(level, minlength=256)
        base = np.concatenate([[0], np.cumsum(word[begin + size - 1] + 1)])
        parts = {
            **_coded("context", own - own[0]),
            **_coded("pointer", np.append(begin, len(key))),
            **_coded("base", base),
            **_coded("successor", np.repeat(base[:-1], size) + word),
            "levels": sums / np.maximum(members, 1),
            "prob": level,
            "backoff": backoff.astype(np.float32),
        }
        path = write_shard(folder, parts)
        yield pa.record_batch([pa.array([key[0]]), pa.array([key[-1]]), pa.array([len(key)]), pa.array([int(n.sum())]), pa.array([path])], names=["first", "last", "n", "total", "path"])

    # A context's successors stay together, but for the hot ones: these are cut by their successors.
    cut = F.when(F.col("context").isin(list(hot)), F.col("key").bitwiseAND(WORD)).otherwise(0) if hot else F.lit(0)
    dealt = counts.withColumn("context", F.shiftright("key", 31)).withColumn("_cut", cut).repartitionByRange(max(1, rows // p.shard_rows), "context", "_cut").sortWithinPartitions("key")
    shards = sorted(_shards(dealt.select("key", "n"), write, "pair-shards"), key=lambda s: s["first"])
    # Pairs below a shard's first belong to it all the same, unless its first context began in the shard before.
    for before, s in zip([None, *shards], shards):
        if before is None or before["last"] >> 31 < s["first"] >> 31:
            s["first"] = s["first"] >> 31 << 31
    return shards


def word_counts(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of words by their numbers; zero for what the model does not know."""
    out, offsets = np.zeros(len(ids), dtype=np.int64), np.array([s["offset"] for s in model.words.shards])
    where = np.searchsorted(offsets, ids, side="right") - 1
    where[ids >= model.v] = -1
    for k, s in enumerate(model.words.shards):
        own = where == k
        if own.any():
            out[own] = read_shard(s["path"])["count"][ids[own] - s["offset"]]
    return out


def fit(docs: DataFrame, p: LmParams = LmParams()) -> Model:
    """The model of all given texts."""
    folder = new_folder(docs.sparkSession, "trie")
    words = word_shards(stored(count_words(docs, p), "word-counts"), folder, p)
    return Model(words, pair_shards(docs, Model(words, [], p, folder), folder), p, folder)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with n_tokens, n_known, base_score and score."""
    p, carry = model.p, list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros((2, b.num_rows), dtype=np.int64)
            logs = np.zeros((2, b.num_rows))
            for first, texts in runs(b.column("text"), p.run_bytes):
                ids, lengths = numbers(model, texts)
                keys, back = np.unique(pairs_of(ids, lengths, model.v + 1), return_inverse=True)
                # Counts and logarithms are taken once for each word of the run.
                each, place = np.unique(keys & WORD, return_inverse=True)
                counts = word_counts(model, each)
                plain = np.log10(model.word_prob(counts))[place]
                counts = counts[place]
                pair = model.pair_logs(keys, counts)
                starts = np.cumsum(lengths) - lengths
                own = slice(first, first + len(texts))
                n[0, own], n[1, own] = lengths, np.add.reduceat((counts > 0)[back].astype(np.int64), starts)
                logs[0, own], logs[1, own] = np.add.reduceat(plain[back], starts), np.add.reduceat(pair[back], starts)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *map(pa.array, n), *map(pa.array, logs)], names=[*carry, "n_tokens", "n_known", "base_score", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select(*carry, "text").mapInArrow(run, f"{schema}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
