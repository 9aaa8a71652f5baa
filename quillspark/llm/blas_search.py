"""Ranked lexical search: tiles of item vocabulary times tiles of document impacts, as dense products in float64.

All numbers are whole. A tile takes an item's terms only as long as their largest possible sum stays under 2^53, so each
product is exact in float64 whatever order BLAS adds in; the tiles' products are added as 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrow_words import runs, split
from quillspark.llm.common import ascii_lower, stored

#: What parts terms: every ASCII character that is neither a letter nor a digit.
PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The same for whole buffers of UTF-8: A-Z become a-z, what parts terms a space; bytes of longer characters stay.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: No term's impact exceeds it: (10^9 tf) div (1000 tf + 8 m) with m of at least 25.
MOST = 10**6


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    #: Items, and pairs of an item and a term, that one pass over the documents takes.
    pass_items: int = 256
    pass_terms: int = 1 << 15
    tile_terms: int = 1024
    tile_docs: int = 1024


def terms(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), PARTS), "")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and n, its occurrences. Rows that are alike count once; texts of one id are taken together."""
    said = items.select("item_id", "text").distinct()
    return said.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


@dataclass
class Tile:
    """Columns of the item matrix: the vocabulary number of each, and the items' counts."""

    columns: list[int] = field(default_factory=list)
    counts: list[tuple[int, int, int]] = field(default_factory=list)  # (item, column, count)
    bound: dict[int, int] = field(default_factory=dict)  # the largest sum that an item can reach


def tiles(rows: list[tuple[int, int, int]], weight: list[int], most: int, limit: int = 1 << 53) -> list[Tile]:
    """Deal (item, term, count), sorted by term, into tiles of at most `most` columns whose sums stay under `limit`.

    A count that alone could pass the limit is dealt in portions over several tiles.
    """
    out, by_term = [Tile()], {}
    for item, term, n in rows:
        by_term.setdefault(term, []).append((item, n))
    for term, found in by_term.items():
        each = weight[term] * MOST
        if not each:
            continue
        while found:
            tile, rest = out[-1], []
            if len(tile.columns) == most:
                out.append(tile := Tile())
            column, used = len(tile.columns), False
            for item, n in found:
                room = (limit - 1 - tile.bound.get(item, 0)) // each
                take = min(n, room)
                if take:
                    tile.counts.append((item, column, take))
                    tile.bound[item] = tile.bound.get(item, 0) + take * each
                    used = True
                if take < n:
                    rest.append((item, n - take))
            if used:
                tile.columns.append(term)
            if rest:
                out.append(Tile())
            found = rest
    return [t for t in out if t.columns]


def counted(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (terms of the text), ids and tfs: the vocabulary's terms in it and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for b in batches:
            for first, texts in runs(b.column("text").cast(pa.string())):
                texts = pa.concat_arrays([texts])
                _, offsets, data = texts.buffers()
                at = np.frombuffer(offsets, dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :]
                plain = data.slice(at[0], at[-1] - at[0]).to_pybytes().translate(BYTES) if data else b""
                found, n = split(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(plain)))
                ids = pc.index_in(found, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(texts)), n)[ids >= 0]
                keys, tf = np.unique(owner * size + ids[ids >= 0], return_counts=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(keys // size, minlength=len(texts)))]).astype(np.int32)
                ids, tf = pa.array((keys % size).astype(np.int32)), pa.array(tf.astype(np.int32))
                yield pa.record_batch([b.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, tf)], names=["doc_id", "n", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, ids array<int>, tfs array<int>")


def frequencies(found: DataFrame, size: int) -> DataFrame:
    """id and df: the documents that hold a term. Each task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column("ids").flatten().to_numpy(zero_copy_only=False), minlength=size)
        yield pa.record_batch([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], names=["id", "df"])

    return found.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))


def best(found: DataFrame, ids: pa.Array, cut: list[Tile], weight: list[int], rows: int, total: int, p: SearchParams) -> DataFrame:
    """item_id, doc_id and score: each task's k highest of every item, ties by doc_id (null ids last)."""
    weights = np.array(weight, dtype=np.int64)

    def laid_out(t: Tile) -> tuple[np.ndarray, np.ndarray]:
        a, place = np.zeros((len(ids), len(t.columns))), np.full(len(weights), -1, dtype=np.int32)
        for item, column, n in t.counts:
            a[item, column] = n
        place[t.columns] = np.arange(len(t.columns))
        return a, place

    def scores(matrices: list, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * rows) // max(1, total)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        out = np.zeros((len(ids), len(n)), dtype=np.int64)
        for a, place in matrices:
            column = place[term]
            dense = np.zeros((a.shape[1], len(n)))
            dense[column[column >= 0], owner[column >= 0]] = impact[column >= 0]
            out += (a @ dense).astype(np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, held, floor = [laid_out(t) for t in cut], None, np.ones(len(ids), dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, p.tile_docs):
                part = b.slice(at, p.tile_docs)
                n, lists = part.column("n").to_numpy(), part.column("ids")
                owner = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
                s = scores(matrices, n, owner, lists.flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(np.int64))
                # All that reach the tile's k-th score stay until ids have decided between equals.
                kth = np.partition(s, -p.k, axis=1)[:, -p.k] if s.shape[1] > p.k else floor
                item, doc = np.nonzero(s >= np.maximum(kth, floor)[:, None])
                if not len(item):
                    continue
                new = pa.table([pa.array(item), pa.array(s[item, doc]), part.column("doc_id").take(pa.array(doc))], names=["item", "score", "doc_id"])
                both = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
                both = both.take(pc.sort_indices(both, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
                item = both.column("item").to_numpy()
                place = np.arange(len(item)) - np.searchsorted(item, item)
                held = both.filter(pa.array(place < p.k)).combine_chunks()
                last = place == p.k - 1
                floor[item[last]] = both.column("score").to_numpy()[last]
        if held is not None:
            for b in held.to_batches():
                yield pa.record_batch([ids.take(b.column("item")), b.column("doc_id"), b.column("score")], names=["item_id", "doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"item_id long, doc_id {kind}, score long")


def weight_of(rows: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """item_id (long), rank (from 1), doc_id and score of each item's k highest-scoring documents with a score above 0.

    Null texts have no terms, and an item without terms gets no rows. A null item_id is an item like others; a null doc_id ranks
    behind its equals. Repeated documents rank one by one. Empty tables give no rows; other columns play no part. Items are
    taken in passes of bounded size, each of which reads the documents once: the vocabulary of a pass is all that the driver holds.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items), "item-terms")
    size = wanted.agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("rows")).first()
    passes, out = max(1, -(-size["items"] // p.pass_items), -(-size["rows"] // p.pass_terms)), []
    for i in range(passes):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).toArrow()
        if not own.num_rows:
            continue
        item, term = (own.column(c).combine_chunks().dictionary_encode() for c in ("item_id", "term"))
        vocabulary = term.dictionary
        # A null id has no place in a dictionary: it comes last.
        ids = pa.concat_arrays([item.dictionary, pa.nulls(1, item.dictionary.type)])
        items_of = item.indices.fill_null(len(ids) - 1).to_pylist()
        found = stored(counted(docs, vocabulary), "item-terms-of-documents")
        rows, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["id"]: r["df"] for r in frequencies(found, len(vocabulary)).collect()}
        weight = [weight_of(rows, df.get(t, 0)) for t in range(len(vocabulary))]
        dealt = sorted(zip(items_of, term.indices.to_pylist(), own.column("n").to_pylist()), key=lambda x: (x[1], x[0]))
        out.append(best(found, ids.cast(pa.int64()), tiles([x for x in dealt if x[1] in df], weight, p.tile_terms), weight, rows, total, p))
    if not out:
        return spark.createDataFrame([], f"item_id long, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score")
