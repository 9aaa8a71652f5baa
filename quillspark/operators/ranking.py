"""Ranking by fields and concepts: one scorer for all variants, then boosts by what is known of a document.

A document is read once: its length and what it holds of the queries' terms, by field, are stored; everything after works
on that. Terms fold into concepts in two steps of aggregation, by (query, document, concept) and by (query, document).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import primary_stems, sub_stems, tokens, weighted_stems
from quillspark.operators.index import idf
from quillspark.operators.synonyms import expanded
from quillspark.session import cut


def stems(c: Column) -> Column:
    """What a text is indexed by where particles are cut off: words, their stems, and pairs of syllables."""
    return F.concat(primary_stems(c), sub_stems(c))


@dataclass(frozen=True)
class Scoring:
    """k1 and b; a cap on a term's count; the factor of a term that the name holds, too; whether coverage of the query's
    concepts (of those in the corpus alone, if `present`) scales the score; what a new document gains, falling by e in
    `decay_days`; how often a concept may give what its strongest term can at most; whether scores are a share of the most
    that any document could reach."""

    k1: float = 1.5
    b: float = 0.75
    cap: int | None = None
    name_boost: float = 1.0
    coverage: bool = False
    present: bool = False
    recency: float = 0.0
    decay_days: float = 180.0
    concept_cap: float | None = None
    absolute: bool = False


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def field_hits(docs: DataFrame, fields: dict[str, tuple[Column, int]], wanted: list[str], keep: list[str], name: Column | None = None, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """doc_id, dl, the kept columns, first (one row of each document) and, for each wanted term that it holds, term, tf and named.

    fields: text and how often each of its terms counts. dl counts all terms alike. `named`: the name holds the term. A
    document without wanted terms has one row with a null term, so that numbers of documents and lengths come from here, too.
    wanted are the terms of queries, not of documents: few.
    """
    held = [f"_f{i}" for i in range(len(fields))]
    weights = [w for _, w in fields.values()]
    # A row that is exploded from a one-element array stays a column of its own: its token arrays are computed once, for the
    # lengths and for what is kept of them.
    cut_up = F.struct(*[tokenize(c).alias(h) for h, (c, _) in zip(held, fields.values())], (tokenize(name) if name is not None else F.array().cast("array<string>")).alias("_name"))
    rows = docs.select("doc_id", *keep, F.explode(F.array(cut_up)).alias("_t"))
    only = lambda h: F.filter(F.col(f"_t.{h}"), lambda x: x.isin(wanted))
    dl = _sum([F.size(F.col(f"_t.{h}")) * w for h, w in zip(held, weights)]).cast("long")
    stored = cut(rows.select("doc_id", *keep, dl.alias("dl"), *[only(h).alias(h) for h in held], only("_name").alias("_name")))
    count = lambda t: _sum([F.size(F.filter(h, lambda x: x == t)) * w for h, w in zip(held, weights)])
    found = F.transform(F.array_distinct(F.concat(*held)), lambda t: F.struct(t.alias("term"), count(t).cast("long").alias("tf"), F.array_contains("_name", t).alias("named")))
    rows = stored.select("doc_id", "dl", *keep, F.posexplode_outer(found).alias("pos", "h"))
    return rows.select("doc_id", "dl", *keep, (F.coalesce("pos", F.lit(0)) == 0).alias("first"), "h.term", "h.tf", "h.named")


def flat_terms(queries: DataFrame, static: DataFrame | None = None, mined: DataFrame | None = None) -> DataFrame:
    """query_id, term, weight and concept of (query_id, term): every term, and every synonym if there are tables of them, is a concept of its own."""
    own = queries.select("query_id", "term").distinct() if static is None else expanded(queries, ["query_id"], static, mined)
    return own.select("query_id", "term", F.lit(1.0).alias("weight"), F.col("term").alias("concept"))


def concept_terms(queries: DataFrame, static: DataFrame, mined: DataFrame) -> DataFrame:
    """query_id, term, weight and concept of (query_id, text).

    A word of the query is a concept, and its synonyms belong to it (to the first of two words that share one). Pairs of
    syllables weigh less and belong to none, as do synonyms of theirs and days that are put together.
    """
    base = queries.select("query_id", F.posexplode(F.map_entries(weighted_stems(F.col("text")))).alias("pos", "e")).select("query_id", "pos", "e.key", "e.value")
    base = cut(base.select("query_id", "pos", F.col("key").alias("term"), F.col("value").alias("weight")))
    grouped = expanded(base.where("weight >= 1"), ["query_id", "pos"], static, mined)
    owner = grouped.groupBy("query_id", "term").agg(F.min("pos").cast("string").alias("concept"))
    every = expanded(base, ["query_id"], static, mined)
    met = every.join(owner, ["query_id", "term"], "left").join(base.select("query_id", "term", "weight"), ["query_id", "term"], "left")
    weight = F.coalesce("weight", F.lit(1.0))
    return met.select("query_id", "term", weight.alias("weight"), F.when(weight >= 1, F.col("concept")).alias("concept"))


def scored(hits: DataFrame, terms: DataFrame, p: Scoring = Scoring(), age_days: Column | None = None, factor: Column | None = None) -> DataFrame:
    """query_id, doc_id, score and matched (concepts) of documents with a score above 0.

    hits: from `field_hits`; terms: query_id, term, weight, concept (null: counts for no coverage). age_days (null: no date)
    and factor are expressions over the kept columns. Every query's terms and each document's hits are joined by term.
    """
    held = hits.where("term is not null")
    # One row for all documents.
    alone = hits.where("first").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl")).first()
    n, avgdl = alone["n"], alone["avgdl"] or 1.0
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    known = cut(terms.join(df, "term").withColumn("idf", idf(F.lit(n), F.col("df"))).where("idf > 0"))
    full = p.k1 + 1
    asked = (known if p.present else terms).groupBy("query_id").agg(F.count_distinct("concept").alias("_asked"))
    caps = known.where("concept is not null").groupBy("query_id", "concept").agg((F.max("idf") * full).alias("_cap"))
    loose = known.where("concept is null").groupBy("query_id").agg((F.sum(F.col("weight") * F.col("idf")) * full).alias("_loose"))
    most = caps.groupBy("query_id").agg(F.sum("_cap").alias("_most")).join(loose, "query_id", "full_outer")
    most = most.select("query_id", ((F.coalesce("_most", F.lit(0.0)) + F.coalesce("_loose", F.lit(0.0))) * (1 + p.recency)).alias("_denominator"))

    tf = F.least("tf", F.lit(p.cap)) if p.cap else F.col("tf")
    given = F.col("weight") * F.col("idf") * tf * full / (tf + p.k1 * (1 - p.b + p.b * F.col("dl") / avgdl))
    kept = F.struct((age_days if age_days is not None else F.lit(None).cast("double")).alias("age"), (factor if factor is not None else F.lit(1.0)).alias("factor"))
    parts = held.join(known.drop("df"), "term").select("query_id", "doc_id", "concept", kept.alias("kept"), (given * F.when(F.col("named"), p.name_boost).otherwise(1.0)).alias("s"))
    folded = parts.groupBy("query_id", "doc_id", "concept").agg(F.sum("s").alias("s"), F.first("kept").alias("kept"))
    if p.concept_cap:
        folded = folded.join(caps, ["query_id", "concept"], "left").withColumn("s", F.least("s", F.coalesce(p.concept_cap * F.col("_cap"), "s")))
    whole = folded.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.count("concept").alias("matched"), F.first("kept").alias("kept")).where("score > 0")
    score = F.col("score")
    if p.coverage:
        whole = whole.join(asked, "query_id")
        score = score * F.when(F.col("_asked") > 1, F.sqrt(F.col("matched") / F.col("_asked"))).otherwise(1.0)
    if p.recency:
        score = score * F.coalesce(1 + p.recency * F.exp(-F.greatest("kept.age", F.lit(0.0)) / p.decay_days), F.lit(1.0))
    if p.absolute:
        whole = whole.join(most, "query_id")
        score = F.least(score / F.col("_denominator"), F.lit(1.0))
    return whole.select("query_id", "doc_id", (score * F.col("kept.factor")).alias("score"), "matched")


def best(found: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Each query's k best rows by rounded score, then id, with rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def shared_tags(tags: Column, asked: Column, each: float = 0.10, most: float = 0.20) -> Column:
    """A tenth for every tag that is asked for, two at most."""
    return F.least(F.lit(most), each * F.size(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(F.array_contains(asked, F.lower(t)), F.lit(False)))))


def boosted(score: Column, persona: Column, tags: Column, status: Column, proposal: Column, outdated: Column, context: Column) -> Column:
    """A score in [0, 1] after what speaks for and against a document.

    A tenth more for the speaker's own tag, the shares of `shared_tags` and of the status; half for a proposal; a quarter less
    if it is outdated; and 0.3 times the share of the conversation's terms that its text holds.
    """
    times = (1 + F.when(persona, 0.1).otherwise(0.0) + tags + status) * F.when(proposal, 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * times + F.when(outdated, -0.25).otherwise(0.0) + 0.3 * context))


def reranked(score: Column, overlap: Column, speaker: Column, persona: Column, tags: Column, kind: Column, status: Column, outdated: Column, vector: float = 0.6, keyword: float = 0.3) -> Column:
    """The search's score and the share of the query's stems in a passage, weighted, times what speaks for it; 0.3 less if it is outdated."""
    times = 1 + F.when(speaker, 0.1).otherwise(0.0) + F.when(persona, 0.15).otherwise(0.0) + tags + F.when(F.lower(kind).isin("spec", "guide", "reference"), 0.05).otherwise(0.0) + status
    return (vector * score + keyword * overlap) * times + F.when(outdated, -0.3).otherwise(0.0)


def passage(sections: Column, stems: Column) -> Column:
    """pos (from 0) and text of the first section, blank ones aside, that holds most of the stems; null without one."""
    found = F.transform(sections, lambda s, i: F.struct(F.size(F.filter(stems, lambda t: F.contains(F.lower(s), t))).alias("hits"), (-i).alias("back"), s.alias("text")))
    most = F.array_max(F.filter(found, lambda x: F.trim(x["text"]) != ""))
    return F.when(most.isNotNull(), F.struct((-most["back"]).alias("pos"), most["text"].alias("text")))


def share_of(text: Column, terms: list[str]) -> Column:
    """The share of the terms that a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _sum([F.contains(low, F.lit(t)).cast("int") for t in terms]) / len(terms) if terms else F.lit(0.0)
