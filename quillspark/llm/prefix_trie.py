"""The trie of conversations' shared beginnings: a node for each distinct sequence of first turns.

A prefix is known by a 128-bit digest, the XOR of its turns' digests, each mixed with its place. A count-min sketch of
all digests proves most of them singletons: what hangs below belongs to one conversation and is emitted where it lies.
Only prefixes that may be shared are shuffled and grouped exactly. Texts are digested when read and never shuffled.

No conversation, node or list of members meets in one task as a whole: running totals go by blocks of turns, counts are
summed before they are shuffled, and the hash of a node's members is fed from sorted parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import count_min
from quillspark.llm.common import ranked, small_side, stored

EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@dataclass(frozen=True)
class TrieParams:
    #: Turns of a conversation that one task runs through; longer conversations are dealt in blocks.
    block: int = 4096
    #: Bound on the sketch's counters a row (three rows of two bits).
    width: int = 1 << 27
    #: Conversation ids that are joined into one string.
    part: int = 8192


def ordered(conversations: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """conv_id, rank (from 0, by turn, null first), t (digest of role and text) and bytes of the text.

    Turns of one number go by their digest. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("t"), F.octet_length(text).cast("long").alias("bytes")
    )
    block = F.coalesce(F.expr(f"turn div {p.block}"), F.lit(-(1 << 62)))
    finer = F.struct("turn", F.conv(F.substring("t", 1, 4), 16, 10).cast("int").alias("t"))
    numbered = ranked(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "t"], block, finer, p.block)
    return stored(numbered.select("conv_id", F.col("rank").cast("long").alias("rank"), "t", "bytes"), "turns")


def rebuilt(conversations: DataFrame, p: TrieParams = TrieParams()) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike: the first h turns of conversation c - c % 5, then the own turns after the first h.

    h is crc32(c as decimal) % 9. Gives (conv_id, d, len, t, bytes) of each rebuilt turn, d from 1, and (conv_id, len).
    """
    turns = ordered(conversations, p)
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = own.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % 9
    met = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base")).join(base, "base", "left")
    first = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = stored(met.select("conv_id", "base", "h", first.alias("first"), (first + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    later = turns.join(convs.drop("base"), "conv_id").where(F.col("rank") >= F.col("h")).select("conv_id", (F.col("first") + F.col("rank") - F.col("h") + 1).alias("d"), "len", "t", "bytes")
    heads = turns.where((F.col("conv_id") % 5 == 0) & (F.col("rank") < 8)).select(F.col("conv_id").alias("base"), "rank", "t", "bytes")
    begun = convs.join(heads, "base").where(F.col("rank") < F.col("first")).select("conv_id", (F.col("rank") + 1).alias("d"), "len", "t", "bytes")
    return later.unionByName(begun), convs.select("conv_id", "len")


def running(df: DataFrame, add, columns: list[str], long: Column, p: TrieParams) -> DataFrame:
    """Add to each row (conv_id, d) for each column `<c>_run`, the fold of its conversation's rows up to it, and `<c>_all`.

    Rows are folded within blocks of a conversation; the blocks of conversations that have several (`long`), far fewer than
    the rows, are folded up to each block's start. `add` is an aggregate such as sum or bit_xor; `columns` hold no nulls.
    """
    df = df.withColumn("_block", F.expr(f"(d - 1) div {p.block}"))
    blocks = df.where(long).groupBy("conv_id", "_block").agg(*[add(c).alias(c) for c in columns])
    conv = Window.partitionBy("_c").orderBy("_b")
    starts = blocks.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), *columns)
    starts = stored(starts.select("_c", "_b", *[add(c).over(conv.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{c}") for c in columns], *[add(c).over(Window.partitionBy("_c")).alias(f"_{c}_all") for c in columns]), "block-starts")
    inside = Window.partitionBy("conv_id", "_block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id", "_block")
    df = df.select("*", *[add(c).over(inside).alias(f"{c}_run") for c in columns], *[add(c).over(whole).alias(f"{c}_all") for c in columns])
    met = df.join(small_side(starts), (F.col("conv_id") == F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    fold = (lambda a, b: a.bitwiseXOR(b)) if add is F.bit_xor else (lambda a, b: a + b)
    for c in columns:
        met = met.withColumn(f"{c}_run", fold(F.col(f"{c}_run"), F.coalesce(f"_{c}", F.lit(0).cast("long")))).withColumn(f"{c}_all", F.coalesce(f"_{c}_all", f"{c}_all"))
    return met.drop("_block", "_c", "_b", *[f"_{c}" for c in columns], *[f"_{c}_all" for c in columns])


def prefixes(turns: DataFrame, p: TrieParams) -> DataFrame:
    """conv_id, d, len, bytes, the digest (p1, p2) of the first d turns and that of one turn less (q1, q2)."""
    mixed = turns.select("conv_id", "d", "len", "bytes", F.xxhash64(F.lit(0), "d", "t").alias("p1"), F.xxhash64(F.lit(1), "d", "t").alias("p2"))
    folded = running(mixed, F.bit_xor, ["p1", "p2"], F.col("len") > p.block, p)
    before = lambda c: F.col(f"{c}_run").bitwiseXOR(F.col(c))
    return folded.select("conv_id", "d", "len", "bytes", F.col("p1_run").alias("p1"), F.col("p2_run").alias("p2"), before("p1").alias("q1"), before("p2").alias("q2"))


def screened(found: DataFrame, p: TrieParams) -> DataFrame:
    """Add `single` and `parent_single`: the sketch proves that no other conversation begins so. The root is never single.

    What continues a single prefix is single too, even where all its counters are shared: it goes by its conversation's first.
    """
    width = count_min.width_for(found.count(), p.width)
    bits = count_min.repeated(found, "p1", "p2", width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda c: b.column(c).to_numpy()
            yield b.filter(pa.array(count_min.once(bits, at("p1"), at("p2"), width)))

    proved = found.select("conv_id", "d", "p1", "p2").mapInArrow(run, "conv_id long, d long, p1 long, p2 long")
    firsts = stored(proved.groupBy(F.col("conv_id").alias("_c")).agg(F.min("d").alias("_d")), "first-singles")
    met = found.join(small_side(firsts), F.col("conv_id") == F.col("_c"), "left")
    return met.withColumns({"single": F.coalesce(F.col("d") >= F.col("_d"), F.lit(False)), "parent_single": F.coalesce(F.col("d") > F.col("_d"), F.lit(False))}).drop("_c", "_d")


def member_hashes(ends: DataFrame, p: TrieParams) -> DataFrame:
    """p1, p2 and the SHA-256 of the sorted, comma-joined conv_ids. Members are sorted and joined by ranges; one task only feeds a node's parts to its hash."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[int]]] = []

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([h[i] for h in held], pa.int64()) for i in range(3)] + [pa.array([",".join(map(str, h[3])) for h in held], pa.string())], names=["p1", "p2", "first", "ids"])
            held.clear()
            return out

        for b in batches:
            for a, z, c in zip(*[b.column(n).to_pylist() for n in ("p1", "p2", "conv_id")]):
                if held and held[-1][:2] == (a, z) and len(held[-1][3]) < p.part:
                    held[-1][3].append(c)
                else:
                    if len(held) > 4096 or held and len(held[-1][3]) == p.part:
                        yield flush()
                    held.append((a, z, c, [c]))
        if held:
            yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for b in batches:
            out = []
            for a, z, ids in zip(*[b.column(n).to_pylist() for n in ("p1", "p2", "ids")]):
                if key == (a, z):
                    now.update(b",")
                else:
                    if key:
                        out.append((*key, now.hexdigest()))
                    key, now = (a, z), hashlib.sha256()
                now.update(ids.encode())
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["p1", "p2", "ends"])
        if key:
            yield pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.array([now.hexdigest()])], names=["p1", "p2", "ends"])

    dealt = ends.select("p1", "p2", "conv_id").repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id")
    joined = dealt.mapInArrow(parts, "p1 long, p2 long, first long, ids string")
    return joined.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(hashed, "p1 long, p2 long, ends string")


def nodes(turns: DataFrame, convs: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """A row for every node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has (conv_id, d from 1, len, t, bytes), `convs` every conversation's (conv_id, len). No conversations: no rows.
    Repeated conversations are members of the same nodes; those without turns are members of the root alone.
    """
    spark = turns.sparkSession
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.count_if(F.col("len") > 0).alias("full")).first()
    top = F.lit(root["conv_id"]).cast("long")
    found = stored(screened(stored(prefixes(turns, p), "prefixes"), p), "screened")

    last = F.col("d") == F.col("len")
    tails = found.where("single")
    edge = tails.where(~F.col("parent_single"))  # the first turn that a conversation shares with none
    shared = stored(found.where(~F.col("single")).drop("single", "parent_single"), "shared")

    # Exact grouping of what may be shared.
    grouped = stored(shared.groupBy("p1", "p2").agg(F.min("conv_id").alias("node_conv"), F.count("*").alias("n_convs"), F.count_if(last).alias("n_ends")), "grouped")
    first = F.col("conv_id") == F.col("node_conv")
    own = shared.join(grouped, ["p1", "p2"]).select(
        "conv_id", "d", "len", "p1", "p2", "q1", "q2", "node_conv", "n_convs", F.when(first, 0).otherwise(F.col("bytes")).alias("saved"), F.when(first, 0).otherwise(1).cast("long").alias("other"),
        F.when(first & last & (F.col("n_convs") == F.col("n_ends")), 1).otherwise(0).cast("long").alias("leaf"), F.lit(True).alias("inner"),
    )
    zero = F.lit(0).cast("long")
    ends_alone = edge.select("conv_id", "d", "len", "p1", "p2", "q1", "q2", F.col("conv_id").alias("node_conv"), F.lit(1).cast("long").alias("n_convs"), zero.alias("saved"), zero.alias("other"), (zero + 1).alias("leaf"), F.lit(False).alias("inner"))
    folded = running(own.unionByName(ends_alone), F.sum, ["saved", "other", "leaf"], F.col("len") > p.block, p)
    below = lambda c: F.col(f"{c}_all") - F.col(f"{c}_run")
    # A member that comes first in the next node stands for that child; one that comes first in its leaf stands for the leaf.
    stats = stored(folded.select("conv_id", "d", "p1", "p2", "q1", "q2", "node_conv", "n_convs", "inner", (below("saved") + F.col("saved")).alias("saved"), (below("leaf") + F.col("leaf")).alias("leaf"), ((F.col("d") < F.col("len")) & (below("other") == 0)).alias("child"), (F.col("other") == 0).alias("first")), "shares")
    inner = stored(
        stats.where("inner").groupBy("p1", "p2").agg(
            F.min("node_conv").alias("conv_id"), F.min("d").alias("depth"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("n_convs").alias("n_convs"),
            F.count_if("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        ), "nodes",
    )
    at_root = stats.where("d = 1").agg(F.count_if("first").alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))

    # Names of parents, for nodes below the first turn.
    names = inner.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    one, deep = F.lit(1).cast("long"), F.col("depth") > 1
    alone = tails.select(
        "conv_id", F.col("d").alias("depth"), "q1", "q2", F.col("parent_single"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    ends = member_hashes(shared.where(last).select("p1", "p2", "conv_id").unionByName(convs.where("len = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id")), p)
    ends = stored(ends, "members")
    hashed = inner.join(ends, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY)))
    kept = ["conv_id", "depth", "q1", "q2", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = hashed.select(*kept).unionByName(alone.where(~F.col("parent_single")).select(*kept))
    below_root = named.where(deep).join(names, ["q1", "q2"])
    first_level = named.where(~deep).withColumn("parent_conv_id", top)
    inside = alone.where("parent_single").withColumn("parent_conv_id", F.col("conv_id"))
    root_row = at_root.crossJoin(F.broadcast(ends.where("p1 = 0 and p2 = 0").agg(F.max("ends").alias("ends")))).where(F.lit(root["n"] > 0)).select(
        top.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root["n"]).cast("long").alias("n_convs"), "n_children", (F.col("n_leaves") if root["full"] else one).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    )
    out = root_row.select(*COLUMNS)
    for part in (first_level, below_root, inside):
        out = out.unionByName(part.select(*COLUMNS))
    return out


def trie(conversations: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """The nodes over the rebuilt conversations of a table with conv_id, turn, role and text."""
    return nodes(*rebuilt(conversations, p), p)
