"""URL filtering with pattern rules that are indexed by their rarest literal token.

A rule is a host suffix and a path prefix, or a word that a host's label or a path's part holds; other patterns state the
tokens that any match holds. Tokens are runs of letters and digits. Each rule is indexed under that of its tokens that
the fewest URLs hold; a URL's tokens, whole and without the digits at their end, fetch candidate rules from that index,
and only candidates run their regular expression. A rule without a token can't be indexed: every URL fetches it.

Defined results: null URLs and those without "://" have an empty host and path and meet no indexed rule; repeated rows
give one row each; with no rules every URL gets the default verdict. Extra columns of the input are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, small_side, stored

TOKEN = "[a-z0-9]+"
#: Hosts of gambling, adult, drug and spam sites and of advertising, by words that stand as parts of their labels.
HOST_WORDS = (
    "casino casinos poker roulette jackpot slots lottery bet bets betting bookmaker adult porn xxx sex escort escorts "
    "pills viagra cialis spam spammer warez ad ads adserver adservice banner banners doubleclick popunder track tracker trackers tracking"
).split()
#: Pages that hold no article, by parts of their paths.
PATH_WORDS = "login signin signup logout register cart checkout basket wishlist unsubscribe".split()


def suffix_rule(verdict: str, rule: str) -> dict:
    """A (host, path) rule such as `example.net/en/`: the host and its subdomains, paths that start with the path."""
    host, _, path = rule.partition("/")
    # Paths may go on where the rule ends, so a token at its end needn't be one of the URL.
    tokens = sorted(set(re.findall(f"{TOKEN}(?![a-z0-9]|$)", rule.lower())))
    return {"verdict": verdict, "rule": rule, "tokens": tokens, "pattern": f"^([^/]*\\.)?{re.escape(host)}/{re.escape(path)}", "rank": 1000 + len(rule)}


def pattern_rule(verdict: str, tokens: list[str], pattern: str) -> dict:
    """A regular expression over host and path; any match must hold all of the tokens (with digits behind them or not)."""
    return {"verdict": verdict, "rule": None, "tokens": tokens, "pattern": pattern, "rank": len(pattern)}


def host_word(verdict: str, word: str) -> dict:
    """A word that stands in the host between characters other than letters and digits, digits behind it or not."""
    return pattern_rule(verdict, [word], f"^([^/]*[^a-z0-9/])?{word}[0-9]*([^a-z0-9/][^/]*)?(/|$)")


def path_word(verdict: str, word: str) -> dict:
    """A word that is a whole part of the path, an extension behind it or not, in letters of either case."""
    return pattern_rule(verdict, [word], f"(?i)/{word}(\\.[a-z]+)?(/|$)")


def general_rules() -> list[dict]:
    return [host_word("block", w) for w in HOST_WORDS] + [path_word("block", w) for w in PATH_WORDS]


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path of every row."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    cut = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    return cut.select("page_id", "url", ascii_lower(host).alias("host"), F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def index_rules(spark: SparkSession, rules: list[dict], counts: DataFrame) -> DataFrame:
    """Each rule with `token`, its literal token that the fewest URLs hold (ties: first in the alphabet; "" if it has none)."""
    table = spark.createDataFrame(
        [(k, r["verdict"], r["rule"], r["tokens"], r["pattern"], r["rank"]) for k, r in enumerate(rules)],
        "rule_id int, verdict string, rule string, tokens array<string>, pattern string, rank int",
    )
    literal = table.select("rule_id", F.explode("tokens").alias("token"))
    known = counts.join(F.broadcast(literal.select("token").distinct()), "token")  # the stated rules bound this
    rarest = literal.join(known, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return table.drop("tokens").join(rarest, "rule_id", "left").withColumn("token", F.coalesce("token", F.lit("")))


def tokens_of(where: Column) -> Column:
    """The distinct tokens of host and path, also without digits at their end, and "" for rules without a token."""
    found = F.regexp_extract_all(ascii_lower(where), F.lit(TOKEN), F.lit(0))
    return F.array_union(F.array_union(found, F.transform(found, lambda t: F.regexp_replace(t, "[0-9]+$", ""))), F.array(F.lit("")))


def judge(pages: DataFrame, rules: list[dict], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and n_candidates of every row; the highest-ranked fitting rule decides."""
    spark = pages.sparkSession
    split = parts(pages).withColumn("_where", F.concat("host", "path"))
    # The rules look at host and path alone, so each different address is judged once.
    where = split.select("_where").distinct()
    held = where.select("_where", F.explode(tokens_of(F.col("_where"))).alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    index = small_side(stored(index_rules(spark, rules, counts), "url-rules"))
    fetched = held.join(index, "token").select("_where", "verdict", "rule", "rank", F.expr("_where rlike pattern").alias("_fits"))
    won = fetched.groupBy("_where").agg(
        F.count("*").alias("_n"),
        F.max_by(F.struct("rule", "verdict"), F.when(F.col("_fits"), F.struct("rank", F.coalesce("rule", F.lit("")), "verdict"))).alias("_won"),
    )
    out = split.join(won.withColumnRenamed("_where", "_w"), F.col("_where") == F.col("_w"), "left")
    return out.select("page_id", "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(default)).alias("verdict"), F.coalesce("_n", F.lit(0)).alias("n_candidates"))
