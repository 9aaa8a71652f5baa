"""Term associations and contained windows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators.companions import companions
from quillspark.session import cut


def synonyms(sections: DataFrame, least: int = 3, pmi: float = 2.0, containment: float = 0.5, section_terms: int = 60, best: int = 3) -> DataFrame:
    """term, synonym and pmi: each term's strongest companions within sections (column text).

    A section counts by its rarest `section_terms` terms (part of the measure).
    """
    # An array must be a column before it is counted, else tokens are computed twice.
    found = sections.select(F.explode_outer(F.array(F.array_distinct(tokens(F.col("text"))))).alias("terms")).where(F.size("terms") >= 2)
    # A pair comes no more often than its rarer term, so 2^pmi is at most total / df of the other: such terms have no pairs.
    counts, df, total = companions(found, least, containment, section_terms, 2.0 ** -(pmi - 1e-6))
    own = lambda x: df.select(F.col("t").alias(x), F.col("term").alias(f"term_{x}"), F.col("df").alias(f"d{x}"))
    both = counts.drop("da").join(own("a"), "a").join(own("b"), "b").select(F.col("term_a").alias("a"), F.col("term_b").alias("b"), "c", "da", "db")
    scored = both.withColumn("pmi", F.round(F.log2(F.col("c") * total / (F.col("da") * F.col("db"))), 6)).where(F.col("pmi") >= pmi)
    way = lambda x, y: F.struct(F.col(x).alias("term"), F.col(y).alias("synonym"), "pmi")
    each = scored.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("pmi"), "synonym")).cast("long")).where(F.col("rank") <= best)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def leaks(private: DataFrame, probes: DataFrame, window: int = 40, step: int = 4) -> DataFrame:
    """Distinct (private_id, probe_id) where the probe contains a window of the private text.

    private: private_id, text; probes: probe_id, text. A probe is cut into pieces of half a window, so wherever it holds a
    window it holds one of its pieces within it: texts meet by a piece and each half of a window, then the piece and its
    neighbours are searched for the window. Nothing is missed and nothing else is found.
    """
    block, half = 1000 - 1000 % step, window // 2
    # A character's place in a string is found by counting, so windows are taken from short overlapping blocks.
    t = private.select("private_id", squeezed(F.col("text")).alias("t"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("t") - window, F.lit(0)), F.lit(block))
    blocks = t.select("private_id", F.explode(F.transform(starts, lambda o: F.col("t").substr(o + 1, F.lit(block - step + window)))).alias("s")).where(F.length("s") >= window)
    offsets = F.sequence(F.lit(1), F.length("s") - (window - 1), F.lit(step))
    own = cut(blocks.select("private_id", F.explode(F.transform(offsets, lambda i: F.col("s").substr(i, F.lit(window)))).alias("w")).distinct())
    inside = F.transform(F.sequence(F.lit(1), F.lit(window - half + 1)), lambda i: F.xxhash64(F.col("w").substr(i, F.lit(half))))
    halves = own.select("private_id", "w", F.explode(F.array_distinct(inside)).alias("h"))

    pieces = F.regexp_extract_all(squeezed(F.col("text")), F.lit(f"(?s).{{1,{half}}}"), F.lit(0))
    asked = probes.select("probe_id", F.explode(F.array(pieces)).alias("p"))
    near = lambda i: F.concat(F.when(i > 0, F.get("p", i - 1)).otherwise(""), F.get("p", i), F.coalesce(F.get("p", i + 1), F.lit("")))
    asked = asked.select("probe_id", F.explode(F.transform("p", lambda x, i: F.struct(F.xxhash64(x).alias("h"), near(i).alias("around")))).alias("x")).select("probe_id", "x.h", "x.around")
    met = asked.join(halves.select("h").distinct(), "h", "left_semi")
    return met.join(halves, "h").where(F.contains("around", F.col("w"))).select("private_id", "probe_id").distinct()
