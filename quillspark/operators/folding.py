"""Sections of a size that suits search: small ones join the next, a small last one the one before, large ones part at blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import wikilinks

INTRO = "(intro)"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _joined(a: Column, b: Column) -> Column:
    title = F.when(b["heading"] == INTRO, "").otherwise(F.concat(F.lit("## "), b["heading"], F.lit("\n")))
    return _trim(F.concat(a["body"], F.lit("\n\n"), title, b["body"]))


def _section(i: Column, heading: Column, body: Column) -> Column:
    return F.struct(i.alias("id"), heading.alias("heading"), body.alias("body"))


def merged(sections: Column, least: int) -> Column:
    """An ordered fold: a section under `least` characters takes the next into it; an introduction takes that one's name, too."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        adopts = last["heading"] == INTRO
        both = _section(F.when(adopts, s["id"]).otherwise(last["id"]), F.when(adopts, s["heading"]).otherwise(last["heading"]), _joined(last, s))
        small = (F.size(done) > 0) & (F.length(F.try_element_at(done, F.lit(-1))["body"]) < least)
        return F.when(small, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(s)))

    # An element that isn't there can't be asked for under ANSI rules, so the fold starts with the first section.
    rest = F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0)))
    return F.when(F.size(sections) > 0, F.aggregate(rest, F.slice(sections, 1, 1), step)).otherwise(sections)


def tail_merged(sections: Column, least: int) -> Column:
    """A last section under `least` characters joins the one before it."""
    n = F.size(sections)
    last, before = F.try_element_at(sections, F.lit(-1)), F.try_element_at(sections, F.lit(-2))
    both = _section(before["id"], before["heading"], _joined(before, last))
    return F.when((n >= 2) & (F.length(last["body"]) < least), F.concat(F.slice(sections, 1, F.greatest(n - 2, F.lit(0))), F.array(both))).otherwise(sections)


def parts(body: Column, least: int, most: int) -> Column:
    """A body over `most` characters, cut at blank lines as late as it fits; a tail under `least` stays with the part before it."""
    paragraphs = F.filter(F.split(body, r"\n\s*\n+"), lambda p: _trim(p) != "")

    def step(now: Column, p: Column) -> Column:
        full = (F.length(now["buf"]) + F.length(p) + 2 > most) & (now["buf"] != "")
        longer = F.when(now["buf"] == "", p).otherwise(F.concat(now["buf"], F.lit("\n\n"), p))
        return F.when(full, F.struct(F.concat(now["done"], F.array(_trim(now["buf"]))).alias("done"), p.alias("buf"))).otherwise(F.struct(now["done"].alias("done"), longer.alias("buf")))

    def end(now: Column) -> Column:
        tail, n = _trim(now["buf"]), F.size(now["done"])
        stays = F.concat(F.slice(now["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(now["done"], F.lit(-1)), F.lit("\n\n"), tail)))
        return F.when(tail == "", now["done"]).when((n > 0) & (F.length(tail) < least), stays).otherwise(F.concat(now["done"], F.array(tail)))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    return F.when(F.length(body) <= most, F.array(body)).otherwise(F.aggregate(paragraphs, start, step, end))


def folded(sections: DataFrame, least: int = 300, most: int = 2000) -> DataFrame:
    """doc_id, at and part (from 0), section_id, heading, body and links of each document's sections (doc_id, pos, section_id, heading, body) after the fold.

    The sections of one document, in order of pos, meet in one row; documents are dealt over the cluster. Null bodies count as
    empty. A document's only section stays whatever its size, unless it must be parted.
    """
    row = F.struct("pos", F.col("section_id").alias("id"), "heading", F.coalesce("body", F.lit("")).alias("body"))
    held = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    held = held.select("doc_id", F.transform("s", lambda x: _section(x["id"], x["heading"], x["body"])).alias("s"))
    joined = held.select("doc_id", merged(F.col("s"), least).alias("s")).select("doc_id", F.posexplode(tail_merged(F.col("s"), least)).alias("at", "s"))
    cut = joined.select("doc_id", "at", F.col("s.id").alias("id"), F.col("s.heading").alias("heading"), F.posexplode(parts(F.col("s.body"), least, most)).alias("k", "body"))
    more = F.col("k") > 0
    return cut.select(
        "doc_id", "at", F.col("k").cast("long").alias("part"), F.when(more, F.concat("id", F.lit("_part"), (F.col("k") + 1).cast("string"))).otherwise(F.col("id")).alias("section_id"),
        F.when(more, F.concat("heading", F.lit(" (part "), (F.col("k") + 1).cast("string"), F.lit(")"))).otherwise(F.col("heading")).alias("heading"), "body", wikilinks(F.col("body")).alias("links"),
    )
