"""Term statistics: the inverted index as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import tokens


def postings(docs: DataFrame, text: str = "text", cap: int | None = None) -> DataFrame:
    """doc_id, term, tf of every document."""
    # An outer explode: Spark would compute the tokens once more to leave out texts without any.
    terms = docs.select("doc_id", F.explode_outer(tokens(F.col(text))).alias("term")).where("term is not null")
    tf = F.count("*")
    return terms.groupBy("doc_id", "term").agg((F.least(tf, F.lit(cap)) if cap else tf).cast("long").alias("tf"))


def lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and dl, its number of tokens."""
    return docs.select("doc_id", F.size(tokens(F.col(text))).cast("long").alias("dl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Bm25:
    """One scorer for all variants: the k1 and b, a cap on tf, and whether coverage of the query scales the score."""

    k1: float = 1.5
    b: float = 0.75
    cap: int | None = None
    coverage: bool = False


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _is(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, query: list[str], p: Bm25 = Bm25(), text: str = "text") -> DataFrame:
    """doc_id, score and matched (query terms) of documents with a query term.

    One pass over the texts: only the query's terms are kept per document, so nothing but matches is shuffled.
    """
    query = sorted(set(query))
    counted = docs.select("doc_id", tokens(F.col(text)).alias("t"))
    per_doc = counted.select("doc_id", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(query)).alias("hits"))
    stats = per_doc.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.array_contains("hits", q)).alias(f"df{k}") for k, q in enumerate(query)]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score, matched = F.lit(0.0), F.lit(0)
    for k, q in enumerate(query):
        tf = F.array_size(F.filter("hits", _is(q)))
        tf = F.least(tf, F.lit(p.cap)) if p.cap else tf
        weight = idf(F.lit(n), F.lit(stats[f"df{k}"]))
        score = score + weight * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * F.col("dl") / avgdl))
        matched = matched + (tf > 0).cast("int")
    scored = per_doc.where(F.size("hits") > 0).select("doc_id", score.alias("score"), matched.alias("matched"))
    return scored.withColumn("score", F.col("score") * F.sqrt(F.col("matched") / len(query))) if p.coverage else scored


def top(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best rows by rounded score, then id."""
    return scored.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(k)
