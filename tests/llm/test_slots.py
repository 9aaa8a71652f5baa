"""Virtual slots: sizes, places, versions of the map, growth, and rows of every odd kind."""

import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import slots
from quillspark.llm.common import new_folder
from tests.llm.test_edges import ROWS, docs


def placed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    return all(sorted(x) == list(range(len(x))) for x in by.values())


def test_every_row_has_a_place(spark):
    p = slots.SlotParams(slots=64, shards=3, part_rows=2)
    got = slots.sharded(docs(spark), p).collect()
    want = sorted((i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert placed(got) and all(0 <= r["shard"] < 3 for r in got)
    assert slots.sharded(docs(spark, []), p).collect() == []


def test_a_hot_record_is_numbered_in_parts(spark):
    rows = [(1, "same")] * 500 + [(k, "x" * k) for k in range(200)]
    p = slots.SlotParams(slots=32, shards=4, part_rows=50)
    got = slots.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), p).collect()
    assert len(got) == 700 and placed(got)
    assert len({r["shard"] for r in got if r["doc_id"] == 1 and r["size"] == 12}) == 1


def test_sizes_near_equal(spark):
    r = random.Random(1)
    rows = [(k, "y" * int(r.paretovariate(1.1) * 20)) for k in range(3000)]
    got = slots.sharded(spark.createDataFrame(rows, "doc_id long, text string"), slots.SlotParams(slots=512, shards=8)).collect()
    total = defaultdict(int)
    for x in got:
        total[x["shard"]] += x["size"]
    largest = max(len(t) for _, t in rows) + 8
    mean = sum(total.values()) / 8
    assert len(total) == 8 and (max(total.values()) - min(total.values()) <= 1e-3 * mean or largest > mean)


def test_edits_move_little_and_new_shards_only_take():
    r = random.Random(2)
    p = slots.SlotParams(slots=4096, shards=24)
    loads = [r.randrange(1000, 2000) for _ in range(p.slots)]
    first = slots.rebalance(slots.even(p), loads, p)
    total = lambda owner, n: [sum(x for x, s in zip(loads, owner) if s == k) for k in range(n)]
    t = total(first, 24)
    assert max(t) - min(t) <= 2e-4 * sum(t) / 24
    assert sum(a != b for a, b in zip(first, slots.even(p))) < 0.1 * p.slots
    assert slots.rebalance(first, loads, p) == first
    grown = slots.grow(first, loads, 24)
    assert all(b in (a, 24) for a, b in zip(first, grown))
    t = total(grown, 25)
    assert abs(t[24] - sum(t) / 25) < 2000 and max(t) < 1.05 * sum(t) / 25


def test_one_heavy_slot_leaves_the_others_even():
    p = slots.SlotParams(slots=64, shards=4)
    loads = [100_000] + [10] * 63
    owner = slots.rebalance(slots.even(p), loads, p)
    t = [sum(x for x, s in zip(loads, owner) if s == k) for k in range(4)]
    heavy = owner[0]
    assert t[heavy] == 100_000 and all(abs(x - 210) <= 10 for k, x in enumerate(t) if k != heavy)
    assert slots.rebalance(slots.even(p), [0] * 64, p) == slots.even(p) and slots.grow(slots.even(p), [0] * 64, 4) == slots.even(p)


def test_versions_and_files(spark, tmp_path):
    p = slots.SlotParams(slots=64, shards=4)
    folder = new_folder(spark, "maps")
    rows = docs(spark)
    got = slots.sharded(rows, p, folder).collect()
    assert {r["shard"] for r in slots.load(spark, folder, 0).collect()} == {0, 1, 2, 3}
    latest = slots.load(spark, folder, 1)
    assert latest.count() == 64
    text = F.coalesce("text", F.lit(""))
    key = slots.slot_of(p, "doc_id", (F.octet_length(text) + 8).cast("long"), F.crc32(F.encode(text, "utf-8")))
    slots.write_shards(rows, key, latest, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    pair = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["shard"])
    assert sorted(map(pair, back.collect())) == sorted(map(pair, got)) and set(back.columns) == {*rows.columns, "shard"}
