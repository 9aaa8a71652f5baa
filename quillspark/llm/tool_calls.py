"""Chat formatting: tool calls are linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on their identifier. A call may name several others as its parents; its level is
the largest number of calls on any way up. Each call first follows its latest parent; pointer doubling along these
gives levels, a chain of n calls taking log n joins; calls that another parent would put deeper follow that one, until
none does. Calls are numbered by level, then turn, without gathering a conversation in one task. Arguments are parsed
as VARIANT, whose JSON form has sorted keys and no white space, and tested against the schemas.

Defined results: calls without an identifier stay unlinked; of calls with one identifier the earliest gets the result
and names the parents; of several results the earliest counts, the others are `unlinked`, as are those of no call;
arguments that aren't a JSON object are invalid and have no canonical form; calls on or behind a cycle of parents have
no level and come last; a parent that isn't there counts as none; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ranked, small_side, stored

CALL = "array<struct<id:string,name:string,arguments:string,parents:array<string>>>"


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) whose text is JSON with tool_calls or tool_call_id."""
    body = messages.select("conv_id", "turn", "role", F.from_json("text", f"tool_calls {CALL}, tool_call_id string, content string").alias("m"))
    calls = body.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("pos", "c")).select("conv_id", "turn", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.parents").alias("parent_ids"))
    results = body.where("m.tool_call_id is not null").select("conv_id", F.col("m.tool_call_id").alias("call_id"), "turn", F.col("m.content").alias("content"))
    return calls, results


def with_earlier(df: DataFrame, values: dict[str, Column], block: int = 256) -> DataFrame:
    """Add for each name the largest value of the conversation's earlier turns (null if there is none).

    Turns are dealt in blocks, so that a long conversation meets in no task: inside a block a window looks back, and of
    whole blocks before it the largest values, one for each block, are carried on. Join and window have one key, in
    which nulls are equal, so that the texts are shuffled once.
    """
    names = list(values)
    df = df.withColumns({"_key": F.struct("conv_id", F.floor(F.col("turn") / block).alias("block")), **{f"_v{i}": v for i, v in enumerate(values.values())}})
    tops = df.groupBy(F.col("_key").alias("_k")).agg(*[F.max(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    before = Window.partitionBy("_k.conv_id").orderBy("_k.block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_k", *[F.max(f"_t{i}").over(before).alias(f"_e{i}") for i in range(len(names))]).hint("shuffle_hash")
    inside = Window.partitionBy("_key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    joined = df.join(tops, F.col("_key") == F.col("_k"), "left")
    found = joined.withColumns({n: F.coalesce(F.max(f"_v{i}").over(inside), F.col(f"_e{i}")) for i, n in enumerate(names)})
    return found.drop("_key", "_k", *[f"_{c}{i}" for c in "ve" for i in range(len(names))])


def canonical(c: Column) -> Column:
    """JSON with sorted keys and no white space; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(c))


def problems(schemas: DataFrame, calls: DataFrame) -> DataFrame:
    """Add arguments' canonical form and errors (sorted, empty if valid) to the calls.

    schemas: name, required (array<string>), types (map<string,string>; string, integer, number, boolean, array, object).
    """
    known = small_side(schemas.select(F.col("name").alias("_name"), "required", "types").dropDuplicates(["_name"]), 10_000)
    value = F.try_parse_json("arguments")
    # A variant that is not an object has no map form.
    calls = calls.withColumn("_fields", F.try_variant_get(value, "$", "map<string,variant>")).withColumn("arguments", canonical(F.col("arguments")))
    joined = calls.join(known, F.col("name") == F.col("_name"), "left")
    kind = F.transform_values(F.col("_fields"), lambda k, v: F.schema_of_variant(v))

    def wrong(k: Column, t: Column) -> Column:
        have, want = F.element_at(F.col("_kinds"), k), F.element_at(F.col("types"), k)
        number = have.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        whole = have.rlike("^(BIGINT|DECIMAL\\([0-9]+,0\\))$")
        fits = (
            F.when(want == "string", have == "STRING").when(want == "integer", whole).when(want == "number", number)
            .when(want == "boolean", have == "BOOLEAN").when(want == "array", have.startswith("ARRAY")).when(want == "object", have.startswith("OBJECT"))
            .otherwise(True)
        )
        return have.isNotNull() & ~fits

    typed = joined.withColumn("_kinds", kind)
    missing = F.transform(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.map_keys("_kinds")), lambda k: F.concat(F.lit("missing "), k))
    mistyped = F.transform(F.filter(F.map_keys("types"), lambda k: wrong(k, k)), lambda k: F.concat(F.lit("wrong type of "), k))
    errors = (
        F.when(F.col("_name").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("_kinds").isNull(), F.array(F.lit("arguments are not an object")))
        .otherwise(F.array_sort(F.concat(missing, F.coalesce(mistyped, F.array().cast("array<string>")))))
    )
    return typed.withColumn("errors", errors).drop("_fields", "_kinds", "_name", "required", "types")


def climbed(now: DataFrame, rounds: int) -> DataFrame:
    """call_id and level of calls that each follow at most one other (`above`); null on or behind a cycle."""
    now = stored(now.select("call_id", "above", F.when(F.col("above").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    # After k rounds a pointer skips 2^k calls; what then still points on after passing all calls is on a cycle.
    for _ in range(rounds):
        if now.where("above is not null").isEmpty():
            break
        top = now.select(F.col("call_id").alias("_id"), F.col("above").alias("_above"), F.col("level").alias("_level")).hint("shuffle_hash")
        # Ended pointers need no join.
        moved = now.where("above is not null").join(top, F.col("above") == F.col("_id")).select("call_id", F.col("_above").alias("above"), (F.col("level") + F.col("_level")).alias("level"))
        now = stored(moved.unionByName(now.where("above is null")), "levels")
    return now.select("call_id", F.when(F.col("above").isNull(), F.col("level")).alias("level"))


def levels(calls: DataFrame) -> DataFrame:
    """call_id and level (the most calls above it along parents; null on or behind a cycle) of distinct calls."""
    ids = calls.where("call_id is not null").groupBy("call_id").agg(F.min_by(F.struct("turn", "pos", "parent_ids"), F.struct("turn", "pos")).alias("_c")).select("call_id", "_c.*")
    ids = stored(ids, "call-ids")
    here = ids.select(F.col("call_id").alias("_p"), F.struct("turn", "pos", "call_id").alias("_at")).hint("shuffle_hash")
    edges = ids.select("call_id", F.explode(F.array_distinct("parent_ids")).alias("parent")).join(here, F.col("parent") == F.col("_p")).select("call_id", "parent", "_at")
    edges = stored(edges, "call-edges")
    latest = edges.groupBy("call_id").agg(F.max_by("parent", "_at").alias("above")).withColumnRenamed("call_id", "_c").hint("shuffle_hash")
    now = ids.select("call_id").join(latest, F.col("call_id") == F.col("_c"), "left").select("call_id", "above")
    rounds = ids.count().bit_length() + 1
    # No parent of a cycle has a level, which counts as the deepest.
    deep = F.coalesce("_level", F.lit((1 << 62)))
    while True:
        now = stored(now, "followed")
        found = stored(climbed(now, rounds), "levels")
        of = lambda: found.select(F.col("call_id").alias("_id"), F.col("level").alias("_level")).hint("shuffle_hash")
        best = edges.join(of(), F.col("parent") == F.col("_id")).groupBy("call_id").agg(F.max(F.struct(deep.alias("deep"), "parent")).alias("_best"))
        own = now.where("above is not null").join(of(), F.col("above") == F.col("_id")).select(F.col("call_id").alias("_c"), deep.alias("_own"))
        moved = stored(best.join(own.hint("shuffle_hash"), F.col("call_id") == F.col("_c")).where("_best.deep > _own").select(F.col("call_id").alias("_c"), F.col("_best.parent").alias("_to")), "moved-calls")
        if moved.isEmpty():
            return found
        now = now.join(moved.hint("shuffle_hash"), F.col("call_id") == F.col("_c"), "left").select("call_id", F.coalesce("_to", "above").alias("above"))


def first_results(results: DataFrame) -> DataFrame:
    """_rid and _r, the earliest result of every identifier."""
    return results.where("call_id is not null").groupBy(F.col("call_id").alias("_rid")).agg(F.min(F.struct("turn", "content")).alias("_r"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, pos, call_id, name, arguments, errors, result, result_turn, level and rank (order in the conversation).

    calls: conv_id, turn, pos, call_id, name, arguments and parent_ids; results: call_id, turn and content.
    """
    calls = stored(calls.select("conv_id", "turn", "pos", "call_id", "name", "arguments", "parent_ids"), "calls")
    checked = problems(schemas, calls.drop("parent_ids")).withColumns({"result": F.lit(None).cast("string"), "result_turn": F.lit(None).cast(results.schema["turn"].dataType), "level": F.lit(None).cast("long")})
    # Calls without an identifier meet nothing; in the joins they would all go to one task.
    known = checked.where("call_id is not null").drop("result", "result_turn", "level")
    first = calls.where("call_id is not null").groupBy(F.col("call_id").alias("_cid")).agg(F.min(F.struct("turn", "pos")).alias("_first"))
    level = levels(calls).withColumnRenamed("call_id", "_lid").hint("shuffle_hash")
    # What is known of an identifier comes together first, so that the calls' arguments are shuffled once.
    about = first.join(level, F.col("_cid") == F.col("_lid"), "left").join(first_results(results).hint("shuffle_hash"), F.col("_cid") == F.col("_rid"), "left").select("_cid", "_first", "level", "_r")
    got = lambda c: F.when(F.struct("turn", "pos") == F.col("_first"), F.col(f"_r.{c}"))
    linked = known.join(about.hint("shuffle_hash"), F.col("call_id") == F.col("_cid"), "left").select(*known.columns, got("content").alias("result"), got("turn").alias("result_turn"), "level")
    out = stored(linked.unionByName(checked.where("call_id is null")).select("conv_id", "turn", "pos", "call_id", "name", "arguments", "errors", "result", "result_turn", "level"), "linked-calls")
    # Blocks of levels, cut up by turns where many calls share one; calls without a level come last.
    block = F.coalesce(F.floor(F.col("level") / 64), F.lit(1 << 40))
    order = [F.col("level").asc_nulls_last(), "turn", "pos", "call_id", "name", "arguments"]
    return ranked(out, ["conv_id"], order, block, F.struct("level", F.floor(F.col("turn") / 64)))


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of results that no call got: without an identifier, of one that no call has, or not the earliest of theirs.

    Of rows that are alike in all columns one at most is a call's result. Rows are compared with the earliest of their
    identifier, not sorted, and rows without an identifier meet nothing; so no task holds an identifier's results.
    """
    columns = results.columns
    ids = calls.where("call_id is not null").select(F.col("call_id").alias("_id")).distinct().hint("shuffle_hash")
    # What is compared is a digest, and only results that came twice or more are counted by their text.
    seen = lambda turn, content: F.struct(turn, F.sha2(content, 256))
    about = first_results(results).select("_rid", seen(F.col("_r.turn"), F.col("_r.content")).alias("_seen")).join(ids, F.col("_rid") == F.col("_id"), "left").hint("shuffle_hash")
    met = results.where("call_id is not null").join(about, F.col("call_id") == F.col("_rid"))
    first = F.col("_id").isNotNull() & seen(F.col("turn"), F.col("content")).eqNullSafe(F.col("_seen"))
    met = stored(met.select(*columns, first.alias("_first")), "results")
    again = met.where("_first").groupBy(F.col("call_id").alias("_c")).agg(F.count("*").alias("_k")).where("_k > 1").select("_c")
    again = small_side(stored(again, "repeated-results"))
    copies = met.where("_first").join(again, F.col("call_id") == F.col("_c"), "left_semi").groupBy(*columns).agg(F.count("*").alias("_n"))
    one = copies.groupBy(F.col("call_id").alias("_c")).agg(F.min(F.struct(*columns)).alias("_one"))
    left = copies.join(one, F.col("call_id") == F.col("_c")).withColumn("_n", F.col("_n") - F.struct(*columns).eqNullSafe(F.col("_one")).cast("int"))
    rest = left.where("_n > 0").select(F.explode(F.array_repeat(F.struct(*columns), F.col("_n").cast("int"))).alias("_r")).select("_r.*")
    return results.where("call_id is null").unionByName(met.where("not _first").drop("_first")).unionByName(rest)


def serialised(linked: DataFrame) -> DataFrame:
    """Add `json`: the call, its result and its place as one canonical JSON object."""
    body = F.struct(F.col("arguments").alias("arguments"), F.col("call_id").alias("id"), "level", "name", "rank", F.col("result").alias("result"))
    return linked.withColumn("json", F.to_json(F.try_parse_json(F.to_json(body))))
