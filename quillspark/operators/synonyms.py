"""Queries widened by synonyms: two steps over a stated table, one over a mined one, and days that a query may mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two-digit numbers of a query that can be a month and a day.
MONTHS, DAYS = [f"{m:02d}" for m in range(1, 13)], [f"{d:02d}" for d in range(1, 32)]


def dates(terms: DataFrame, key: list[str]) -> DataFrame:
    """key and term: each month and another number as a day, of a query's two-digit terms (there are at most a hundred)."""
    held = terms.where(F.col("term").rlike(r"\A[0-9]{2}\z")).groupBy(*key).agg(F.collect_set("term").alias("n"))
    pairs = F.transform(F.filter("n", lambda m: m.isin(MONTHS)), lambda m: F.transform(F.filter("n", lambda d: d.isin(DAYS) & (d != m)), lambda d: F.concat(m, d)))
    return held.select(*key, F.explode(F.flatten(pairs)).alias("term"))


def expanded(terms: DataFrame, key: list[str], static: DataFrame, mined: DataFrame) -> DataFrame:
    """key and term, each once: the terms, their synonyms (term, synonym) in both tables, and the static ones of those.

    Mined synonyms start no second step. Null terms are left out; a query without synonyms keeps its terms.
    """
    own = terms.select(*key, "term").where("term is not null").distinct()
    stated = static.select("term", "synonym").where("synonym is not null").distinct()
    pairs = stated.unionByName(mined.select("term", "synonym").where("synonym is not null")).distinct()
    # Two steps are pairs as well, so the terms, far more than pairs, meet them once.
    further = pairs.join(stated.select(F.col("term").alias("synonym"), F.col("synonym").alias("_to")), "synonym").select("term", F.col("_to").alias("synonym"))
    reached = own.join(pairs.unionByName(further).distinct(), "term").select(*key, F.col("synonym").alias("term"))
    return own.unionByName(reached).unionByName(dates(own, key)).distinct()
