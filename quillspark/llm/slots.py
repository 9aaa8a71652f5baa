"""Sharding by fixed virtual slots: records hash into thousands of slots, a stored map says which shard holds a slot.

A record's slot never changes. Shards change by editing the map: each edit is a new version beside the older ones, and
moves only the slots that it must. The map has one row a slot, so it fits the driver and a broadcast at any input size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import new_folder, ranked, stored


@dataclass(frozen=True)
class SlotParams:
    #: Virtual slots, fixed for the life of a data set.
    slots: int = 8192
    shards: int = 24
    #: Moves end when the largest and the smallest shard differ by this share of their mean.
    within: float = 1e-4
    #: Rows of one slot that one task numbers; larger slots are numbered in parts.
    part_rows: int = 200_000


def slot_of(p: SlotParams, *key: str | Column) -> Column:
    """The virtual slot of a record: a hash of its key, never of where it lies."""
    return F.pmod(F.xxhash64(*key), F.lit(p.slots)).cast("int")


def even(p: SlotParams) -> list[int]:
    """The map before any record is known: slots dealt in turn."""
    return [s % p.shards for s in range(p.slots)]


def _by_shard(owner: list[int], loads: list[int], shards: int) -> list[list[tuple[int, int]]]:
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        held[shard].append((loads[slot], slot))
    return [sorted(x) for x in held]


def _nearest(held: list[tuple[int, int]], size: float, below: int) -> tuple[int, int] | None:
    """The slot whose load is nearest to `size`, over 0 and under `below`."""
    at = bisect_left(held, (size, -1))
    found = [x for x in held[max(0, at - 1) : at + 1] if 0 < x[0] < below]
    return min(found, key=lambda x: (abs(x[0] - size), x[1])) if found else None


def rebalance(owner: list[int], loads: list[int], p: SlotParams) -> list[int]:
    """Edit a map until the shards' loads are near equal: the heaviest shard gives a slot to the lightest, or swaps one.

    Each step takes the move or swap that comes nearest to halving the two shards' difference, so it never makes a shard
    heavier than the heaviest was. A shard that no step can ease (one very heavy slot) is left as it is. Slots without
    load stay where they are.
    """
    owner, held = list(owner), _by_shard(owner, loads, p.shards)
    total = [sum(n for n, _ in x) for x in held]
    live, close = set(range(p.shards)), p.within * sum(total) / p.shards
    while len(live) > 1:
        high, low = max(live, key=lambda s: (total[s], s)), min(live, key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        if gap <= close:
            break
        best: tuple[float, tuple[int, int], tuple[int, int] | None] | None = None
        if one := _nearest(held[high], gap / 2, gap):
            best = (abs(one[0] - gap / 2), one, None)
        if best is None or best[0] > close / 4:
            for two in held[low]:
                one = _nearest(held[high], two[0] + gap / 2, two[0] + gap)
                if one and one[0] > two[0] and (best is None or abs(one[0] - two[0] - gap / 2) < best[0]):
                    best = (abs(one[0] - two[0] - gap / 2), one, two)
        if best is None:
            live.discard(high)
            continue
        for moved, source, to in ((best[1], high, low), (best[2], low, high)):
            if moved:
                held[source].remove(moved)
                insort(held[to], moved)
                owner[moved[1]] = to
                total[source], total[to] = total[source] - moved[0], total[to] + moved[0]
    return owner


def grow(owner: list[int], loads: list[int], shards: int) -> list[int]:
    """Add shard number `shards`: it takes slots from the heaviest shards, into itself only, until it holds its share."""
    owner, held = list(owner), _by_shard(owner, loads, shards)
    total, new, share = [sum(n for n, _ in x) for x in held], 0, sum(loads) / (shards + 1)
    while True:
        high = max(range(shards), key=lambda s: (total[s], s))
        slot = _nearest(held[high], share - new, int(share - new) + 1)
        if slot is None:
            return owner
        held[high].remove(slot)
        owner[slot[1]], total[high], new = shards, total[high] - slot[0], new + slot[0]


def store(spark: SparkSession, folder: str, version: int, owner: list[int]) -> None:
    """Write one version of the map beside the older ones; a version is never changed."""
    rows = spark.createDataFrame([(s, shard) for s, shard in enumerate(owner)], "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{folder.rstrip('/')}/version={version}")


def load(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """virtual_slot and shard of one stored version."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{folder.rstrip('/')}/version={version}")


def with_shard(docs: DataFrame, slot: Column, slot_map: DataFrame) -> DataFrame:
    """Add `shard` to whole records. Texts aren't shuffled: the map is broadcast, it has one row a slot."""
    slot_map = slot_map.select(F.col("virtual_slot").alias("_slot"), F.col("shard").alias("_shard"))
    joined = docs.drop("shard").withColumn("_own", slot).join(F.broadcast(slot_map), F.col("_own") == F.col("_slot"))
    return joined.withColumn("shard", F.col("_shard")).drop("_own", "_slot", "_shard")


def write_shards(docs: DataFrame, slot: Column, slot_map: DataFrame, path: str) -> None:
    """Write records into a folder for each shard, by as many tasks as Spark's partitions: a shard isn't one task's work."""
    with_shard(docs, slot, slot_map).withColumn("_part", F.pmod(slot, F.lit(64))).repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, p: SlotParams = SlotParams(), folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot (place in the shard, gapless from 0) of every row.

    A null text counts as empty, a null id as an id of its own, repeated rows each get a place; an empty table gives no
    rows. A record is its id and text, so other columns play no part. Version 0 of the map is `even`, version 1 what
    `rebalance` makes of it once bytes are known; both are stored in `folder` (else beside the other stored tables).
    """
    spark, folder = docs.sparkSession, folder or new_folder(docs.sparkSession, "slot-map")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows = stored(own.withColumn("virtual_slot", slot_of(p, "doc_id", "size", "text_crc32")), "slots")
    # One row a slot comes to the driver, however many records there are.
    held = {r["virtual_slot"]: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    loads = [held[s]["bytes"] if s in held else 0 for s in range(p.slots)]
    first = even(p)
    for version, owner in enumerate((first, rebalance(first, loads, p))):
        store(spark, folder, version, owner)
    parts = spark.createDataFrame([(s, -(-held[s]["n"] // p.part_rows) if s in held else 1) for s in range(p.slots)], "virtual_slot int, _parts long")
    slot_map = load(spark, folder, 1).join(F.broadcast(parts), "virtual_slot")
    # Rows of a stored table keep their place in it, so a repeated task deals a large slot's rows as before.
    placed = rows.select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("_at")).join(F.broadcast(slot_map), "virtual_slot")
    block = F.col("virtual_slot").cast("long") * (1 << 32) + F.pmod("_at", F.col("_parts"))
    numbered = ranked(placed, ["shard"], ["doc_id", "text_crc32", "_at"], block)
    return numbered.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", F.col("rank").cast("long").alias("slot"))
