"""Quality rules: an ordered decision list of threshold conjunctions, learned from labelled statistics.

Statistics are column expressions over whole texts. Sequential covering reads the statistics of a bounded sample
of labelled rows (a parameter) and emits a `CASE WHEN` chain that Spark applies to every document.

Defined results: null and empty texts have zero statistics and fail the base rule; repeated doc_ids give one row
each; labels that are null or contradict each other are left out; with no usable labels the list is empty and only
the base rule rejects. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WHITE, add_all, shingle_hashes, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: The statistics that conditions may test.
FEATURES = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "distinct_ratio", "n_words")


@dataclass(frozen=True)
class CoverParams:
    """max_labels bounds the labelled rows that learning collects; precision is what a rule must reach on held-out rows."""

    max_labels: int = 4000
    max_rules: int = 8
    max_tries: int = 16
    max_conditions: int = 3
    precision: float = 0.95
    min_covered: int = 4


@dataclass(frozen=True)
class Rule:
    """Rejects where every (statistic, "<=" or ">", threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        tests = [F.col(f) <= t if op == "<=" else F.col(f) > t for f, op, t in self.conditions]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def covers(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.conditions)


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), detail: bool = True) -> DataFrame:
    """The carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ratios too with `detail`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = docs.select(
        *carry,
        F.length(F.regexp_replace(text, WHITE, "")).cast("long").alias("word_chars"),
        F.length(text).alias("_chars"),
        add_all([F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS]).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        words(F.col("text")).alias("_words"),
        *([F.regexp_count(text, F.lit("\\p{Lu}")).alias("_upper"), F.regexp_count(text, F.lit("[0-9]")).alias("_digits")] if detail else []),
    ).withColumn("_h", shingle_hashes(F.col("_words"), 5))
    none = F.array().cast("array<bigint>")
    repeats = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).otherwise(none)
    pairs = counted.withColumn("_s", F.sort_array(F.transform(repeats, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    s = F.col("_s")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
    placed = pairs.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # A window at i covers words i to i + 4: add what lies beyond the end of the windows before it.
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + 5 - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + 5).alias("end")),
    )["n"]
    n_words, n_lines = F.size("_words").cast("long"), F.size("_lines")
    out = placed.select(
        *carry,
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        (n_lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        *([F.size(F.array_distinct("_words")).alias("_distinct"), "_upper", "_digits", "_chars", n_lines.alias("_n_lines")] if detail else []),
    )
    if not detail:
        return out
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    ratios = {
        "word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "upper_ratio": F.col("_upper") / c,
        "digit_ratio": F.col("_digits") / c,
        "distinct_ratio": F.col("_distinct") / n,
    }
    return out.withColumns(ratios).drop("_distinct", "_upper", "_digits", "_chars", "_n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, params: CoverParams) -> list[dict]:
    """Statistics and label of at most max_labels labelled documents, picked by a hash of their ids."""
    agreed = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .where("_low = _high")
        .select("doc_id", F.col("_low").alias("_quality"), F.xxhash64("doc_id").alias("_pick"))
        .orderBy("_pick", "doc_id")
        .limit(params.max_labels)
    )
    # The sample is bounded by its limit, so it may be broadcast; of rows that share an id one counts.
    sample = docs.select("doc_id", "text").join(F.broadcast(agreed), "doc_id").groupBy("doc_id", "_quality", "_pick").agg(F.min("text").alias("text"))
    return [r.asDict() for r in statistics(sample, ("doc_id", "_quality", "_pick")).collect()]


def best_condition(rows: list[dict], feature: str) -> tuple[float, tuple] | None:
    """The threshold on one statistic with the largest gain in information about rejected rows (label 0)."""
    from math import log2

    total_p = sum(r["_quality"] == 0 for r in rows)
    total = len(rows)
    if not total_p:
        return None
    ordered = sorted((r[feature], r["_quality"] == 0) for r in rows)
    best, p = None, 0
    for k, (value, bad) in enumerate(ordered[:-1]):
        p += bad
        if value == ordered[k + 1][0]:
            continue
        cut = (value + ordered[k + 1][0]) / 2
        for op, pos, n in (("<=", p, k + 1), (">", total_p - p, total - k - 1)):
            if pos:
                gain = pos * (log2(pos / n) - log2(total_p / total))
                if best is None or gain > best[0]:
                    best = (gain, (feature, op, cut))
    return best


def learn(rows: list[dict], params: CoverParams = CoverParams()) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the rest, cover, repeat."""
    rows = [r for r in rows if not (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])]
    grow = [r for r in rows if r["_pick"] % 3 != 0]
    prune = [r for r in rows if r["_pick"] % 3 == 0]
    rules: list[Rule] = []

    def worth(conditions: list[tuple]) -> tuple[float, int]:
        hit = [r["_quality"] == 0 for r in prune if Rule(tuple(conditions)).covers(r)]
        return (sum(hit) / len(hit) if hit else 0.0), len(hit)

    tried = 0
    while len(rules) < params.max_rules and tried < params.max_tries and any(r["_quality"] == 0 for r in grow):
        tried += 1
        conditions, left = [], grow
        while len(conditions) < params.max_conditions and any(r["_quality"] != 0 for r in left):
            found = max((b for f in FEATURES if (b := best_condition(left, f))), default=None)
            if found is None or found[0] <= 0:
                break
            conditions.append(found[1])
            left = [r for r in left if Rule((found[1],)).covers(r)]
        if not conditions:
            break
        while len(conditions) > 1 and worth(conditions[:-1])[0] >= worth(conditions)[0]:
            conditions.pop()
        rule = Rule(tuple(conditions))
        hit = [r["_quality"] == 0 for r in grow if rule.covers(r)]
        ok, seen = worth(conditions)
        if not (len(hit) < params.min_covered or sum(hit) < params.precision * len(hit) or not seen or ok < params.precision):
            rules.append(rule)
            prune = [r for r in prune if not rule.covers(r)]
        elif not any(hit):
            break
        # Of a rule that isn't sure enough only the rejected rows go: the next one is grown for the others.
        grow = [r for r in grow if not rule.covers(r) or rules[-1:] != [rule] and r["_quality"] != 0]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the number of the first rule that fires, 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), k).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), params: CoverParams = CoverParams()) -> DataFrame:
    """Statistics of every document with base_failed, rule (the list's first rule that fires, else 0) and kept."""
    rules = learn(labelled_statistics(docs, labels, params), params)
    return statistics(docs, carry).withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame, params: CoverParams = CoverParams()) -> DataFrame:
    """The rows, with all their columns, of documents that neither the base rule nor the learned list rejects."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    rules = learn(labelled_statistics(docs, labels, params), params)
    # A condition on a nondeterministic column stays above the statistics: pushed below, it would compute them per word.
    judged = statistics(rows, ("_row",)).withColumn("_here", F.spark_partition_id()).where(~base_failed() & (verdict(rules) == 0) & (F.col("_here") >= 0))
    return judged.select("_row.*")
