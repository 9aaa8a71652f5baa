"""Secrets in texts: fixed detectors, and multipart credentials linked by an interval join.

Every match's place comes from Spark's own split and extract functions: the gaps between matches and the matches
alternate, so their lengths add up to offsets in code points. Weak candidates (bare 40-character keys and endpoints)
are only reported where complementary parts (identifiers, secrets, endpoints) stand near each other in a document: scopes are blocks of positions, and
each part meets those of its own and the neighbouring blocks, so no document is compared with itself as a whole.

Defined results: null and empty texts have no spans; repeated rows give one row each; rows that share an id but not
the text are told apart by the text's hash; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored

KINDS = ("assign", "access", "hex")
# The stated patterns. A run shorter than 20 or 24 characters holds no other match of its kind, so those
# minima stand in the pattern; an assignment may be too short and still use up its characters, so its length is tested after.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    # A bare key has capital and small letters and a digit.
    "key": "(?<![A-Za-z0-9+/=])(?=[a-z0-9+/]{0,39}[A-Z])(?=[A-Z0-9+/]{0,39}[a-z])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": "https?://[A-Za-z0-9.-]+(?::[0-9]+)?",
}
WEAK = ("key", "endpoint")


SPAN = "struct<kind:int,start:int,end:int,ok:boolean>"


def bound(c: Column, body) -> Column:
    """body(c) with c computed once: a lambda's variable is not copied into the inner lambdas as an expression would be."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def placed(pairs: Column, number: int) -> Column:
    """Spans of (gap, hit, ok), the lengths between and of matches in order.

    A fold over m matches that grows an array copies m^2 spans, so blocks of about the root of m are folded, then shifted.
    """
    fields = f"struct<at:int,found:array<{SPAN}>>"
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found")).cast(fields)

    def add(a: Column, x: Column) -> Column:
        first = a["at"] + x["gap"]
        span = F.struct(F.lit(number).alias("kind"), first.alias("start"), (first + x["hit"]).alias("end"), x["ok"].alias("ok"))
        return F.struct((first + x["hit"]).alias("at"), F.concat(a["found"], F.array(span)).alias("found")).cast(fields)

    def shifted(block: Column, by: Column) -> Column:
        return F.transform(block["found"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["ok"].alias("ok")))

    def whole(p: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(p).cast("double"))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / size).cast("int") - 1), lambda k: F.aggregate(F.slice(p, k * size + 1, size), nothing, add))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")).cast("struct<at:int,starts:array<int>>")
        starts = lambda bs: F.aggregate(bs, begin, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")).cast("struct<at:int,starts:array<int>>"))["starts"]
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), shifted)))

    return bound(pairs, lambda p: F.when(F.size(p) > 0, whole(p)).otherwise(F.array().cast(f"array<{SPAN}>")))


def spans(text: Column, kind: str) -> Column:
    """Array of (kind number, start, end) of the pattern's leftmost matches; `text` must be a plain column."""
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    ok = lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 6 if kind == "assign" else F.lit(True)
    # Behind the last match stands one gap more, with no length of a match.
    lengths = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), ok(h).alias("ok"))), lambda x: x["hit"].isNotNull())
    found = F.filter(placed(lengths, list(PATTERNS).index(kind)), lambda s: s["ok"])
    out = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>"))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, _h (the text's hash) and an array of spans of each kind."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", F.xxhash64("text").alias("_h"), *[spans(F.col("text"), k).alias(k) for k in PATTERNS])


def near(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """The rows of a (_d, _h, kind, start, end) that stand within `reach` code points of a row of b in their document."""
    block = lambda c: F.floor(F.col(c) / reach)
    left = a.withColumn("_b", F.explode(F.sequence(block("start") - 1, block("end") + 1)))
    right = b.select(F.col("_d").alias("_d2"), F.col("_h").alias("_h2"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(block("start"), block("end"))).alias("_b2"))
    on = F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")) & (F.col("_b") == F.col("_b2")) & (F.col("_s") <= F.col("end") + reach) & (F.col("start") <= F.col("_e") + reach)
    return left.join(right, on, "left_semi").drop("_b").distinct()


def linked(found: DataFrame, reach: int) -> DataFrame:
    """Weak spans that complete a credential.

    A bare key counts near an access identifier or an endpoint; an endpoint near an access identifier, an assigned secret
    or a key that counts.
    """
    some = found.where((F.size("key") > 0) & (F.size("access") + F.size("endpoint") > 0) | (F.size("endpoint") > 0) & (F.size("access") + F.size("assign") > 0))
    of = lambda kind: some.select(F.col("doc_id").alias("_d"), "_h", F.explode(kind).alias("s")).select("_d", "_h", "s.*").distinct()
    keys = near(of("key"), of("access").unionByName(of("endpoint")), reach)
    return keys.unionByName(near(of("endpoint"), keys.unionByName(of("access")).unionByName(of("assign")), reach))


def joined(c: Column) -> Column:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    in_order = F.array_sort(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(in_order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, reach: int = 256) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of every row."""
    found = stored(parts(docs), "secret-parts")
    weak = linked(found, reach).groupBy("_d", "_h").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak")).withColumnRenamed("_h", "_h2")
    both = found.join(weak, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_h2")), "left")
    both = both.withColumn("base", F.concat(*KINDS))
    # A weak span inside a base span is reported by that one.
    added = F.filter(F.coalesce("weak", F.array().cast("array<struct<kind:int,start:int,end:int>>")), lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return both.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", added)).alias("spans"))
