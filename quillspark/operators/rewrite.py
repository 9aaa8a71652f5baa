"""Rewriting of markdown bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import HANGUL, tokens
from quillspark.session import cut

#: Spans that no link may be put into: fenced and inline code, links, images, headings.
MASKED = r"(?s:```.*?```)|`[^`\n]*`|!?\[\[(?s:.*?)\]\]|!?\[[^\]]*\]\([^)]*\)|(?m:^#.*?$)"
#: A name that begins or ends with such a character must not go on with one.
WORD = "[A-Za-z0-9_]"


def mention_candidates(docs: DataFrame, names: DataFrame, text: str = "body") -> DataFrame:
    """doc_id, name and target of names (name, target) that a document may hold: it has the name's rarest token.

    A name is looked up by the one of its tokens that the fewest documents have, so a million names cost a document only those
    whose rarest token it holds. Names without a token (too short, or marks alone) are offered to all that contain them.
    """
    # Of a run of syllables, which may go on in the text, only its pairs are sure to be among the text's tokens.
    sure = lambda t: ~t.rlike(HANGUL) | (F.length(t) == 2)
    named = cut(names.where("name <> ''").groupBy("name").agg(F.min("target").alias("target")).withColumn("t", F.array_distinct(F.filter(tokens(F.col("name")), sure))))
    parts = named.select("name", F.explode("t").alias("token"))
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    held = cut(held.join(parts.select("token").distinct(), "token", "left_semi"))
    rare = held.groupBy("token").agg(F.count("*").alias("_n"))
    chosen = parts.join(rare, "token").groupBy("name").agg(F.min(F.struct("_n", "token")).alias("_r")).select("name", F.col("_r.token").alias("token"))
    found = held.join(chosen, "token").select("doc_id", "name")
    bare = named.where(F.size("t") == 0).agg(F.collect_list("name").alias("_b"))  # marks and single letters: few
    short = docs.join(F.broadcast(bare)).select("doc_id", F.explode(F.filter("_b", lambda x: F.contains(F.col(text), x))).alias("name"))
    return found.unionByName(short).distinct().join(named.select("name", "target"), "name")


def _spans(body: Column) -> Column:
    """A body as runs, in order: masked ones and free ones."""
    runs = F.regexp_extract_all(body, F.lit(f"{MASKED}|(?:(?!{MASKED})(?s:.))++"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(r.rlike(rf"\A(?:{MASKED})\z").alias("masked"), r.alias("text")))


def _quoted(name: Column) -> Column:
    edge = lambda c, before: F.when(c.rlike(WORD), F.lit(f"(?<!{WORD})" if before else f"(?!{WORD})")).otherwise("")
    return F.concat(edge(F.substring(name, 1, 1), True), F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), edge(F.right(name, F.lit(1)), False))


def linked(body: Column, mentions: Column) -> Column:
    """A body in which the first free occurrence of each mention (structs of name and target, in order) has become a link.

    A mention whose target the body links to already is left out, as is one that stands only in masked runs or in a link made before.
    """

    def step(now: Column, m: Column) -> Column:
        pattern = _quoted(m["name"])
        at = F.array_position(F.transform(now, lambda r: ~r["masked"] & F.rlike(r["text"], pattern)), True).cast("int")
        run = F.try_element_at(now, F.when(at > 0, at).otherwise(1))["text"]
        place, n = F.regexp_instr(run, pattern), F.length(m["name"])
        free = lambda c: F.filter(F.array(F.struct(F.lit(False).alias("masked"), c.alias("text"))), lambda r: r["text"] != "")
        link = F.when(m["target"] == m["name"], F.concat(F.lit("[["), m["name"], F.lit("]]"))).otherwise(F.concat(F.lit("[["), m["target"], F.lit("|"), m["name"], F.lit("]]")))
        new = F.concat(F.slice(now, 1, F.greatest(at - 1, F.lit(0))), free(run.substr(F.lit(1), place - 1)), F.array(F.struct(F.lit(True).alias("masked"), link.alias("text"))), free(run.substr(place + n, F.length(run))), F.slice(now, at + 1, F.greatest(F.size(now) - at, F.lit(0))))
        has = F.exists(now, lambda r: F.contains(r["text"], F.concat(F.lit("[["), m["target"])))
        return F.when((at > 0) & ~has, new).otherwise(now)

    return F.array_join(F.transform(F.aggregate(mentions, _spans(body), step), lambda r: r["text"]), "")


def link_mentions(docs: DataFrame, names: DataFrame, text: str = "body", own: str | None = None) -> DataFrame:
    """doc_id and the text with names (name, target) turned into links, the longest name first; null texts stay null.

    A document's names, as many as it may mention, meet with its text in one row. `own`: the column of a document's own name, not linked.
    """
    docs = docs.select("doc_id", text, *([own] if own else []))
    found = mention_candidates(docs, names, text)
    order = F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("n"), "name", "target")))
    met = docs.join(found.groupBy("doc_id").agg(order.alias("_m")), "doc_id", "left")
    kept = F.filter("_m", lambda m: m["name"] != F.coalesce(F.col(own), F.lit(""))) if own else F.col("_m")
    return met.select("doc_id", F.when(F.size(kept) > 0, linked(F.col(text), kept)).otherwise(F.col(text)).alias(text))


def link_keywords(docs: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """path and body with the first free occurrence of each keyword turned into a link to its hub, longest first. Paths are unique."""
    names = docs.sparkSession.createDataFrame(sorted(keywords.items()), "name string, target string")
    return link_mentions(docs.select(F.col("path").alias("doc_id"), "body"), names).withColumnRenamed("doc_id", "path")


def repair_links(body: Column) -> Column:
    """Close `[[a]` and `[[a` at a line's end, and take links out of links."""
    once = F.regexp_replace(body, r"\[\[([^\[\]\n]+)\](?!\])", "[[$1]]")
    return F.regexp_replace(once, r"\[\[([^\[\]\n]*)\[\[([^\[\]\n]+)\]\]([^\[\]\n]*)\]\]", "[[$2]]")


def replace_ghosts(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """ghost and target: links (docs: ghost, the name of a missing target) that exactly one title (key) starts with, or that start with it.

    Names meet by equality: a title's beginnings with ghosts, whose numbers are counted first, and a ghost's beginnings with
    titles. A short name that all begin with costs one row, whatever its length. Empty names meet nothing.
    """
    ghosts = docs.select("ghost").where("ghost <> ''").distinct()
    begins = lambda c, upto: F.transform(F.sequence(F.lit(1), upto), lambda i: F.substring(F.col(c), F.lit(1), i))
    named = titles.select("key").where("key <> ''")
    longer = named.select("key", F.explode(begins("key", F.length("key"))).alias("ghost")).groupBy("ghost").agg(F.count("*").alias("n"), F.min("key").alias("target"))
    counted = named.groupBy("key").agg(F.count("*").alias("n"))
    shorter = ghosts.where(F.length("ghost") > 1).select("ghost", F.explode(begins("ghost", F.length("ghost") - 1)).alias("key")).join(counted, "key").select("ghost", "n", F.col("key").alias("target"))
    both = ghosts.join(longer, "ghost").select("ghost", "n", "target").unionByName(shorter)
    return both.groupBy("ghost").agg(F.sum("n").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def shared_tag_peers(docs: DataFrame, most: int = 8) -> DataFrame:
    """doc_id and peers: up to `most` documents that share a tag, the last names first (docs: doc_id, title, tags).

    Only a tag's last most + 1 documents can be among anyone's peers, so each document meets no more than these of a tag.
    """
    from pyspark.sql import Window

    tagged = docs.select("doc_id", "title", F.explode("tags").alias("tag")).distinct()
    last = Window.partitionBy("tag").orderBy(F.desc("title"), "doc_id")
    offered = tagged.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most + 1).select("tag", F.col("doc_id").alias("peer"), F.col("title").alias("peer_title"))
    peers = tagged.join(offered, "tag").where("doc_id <> peer").select("doc_id", "peer", "peer_title").distinct()
    w = Window.partitionBy("doc_id").orderBy(F.desc("peer_title"), "peer")
    return peers.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy("doc_id").agg(F.array_sort(F.collect_list("peer")).alias("peers"))


def month_index(docs: DataFrame) -> DataFrame:
    """month, n and markdown: links to each month's dated documents, newest first."""
    dated = docs.where("date rlike '^[0-9]{4}-[0-9]{2}'").select(F.substring("date", 1, 7).alias("month"), "date", "title")
    rows = dated.groupBy("month").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("date", "title")), asc=False).alias("r"))
    return rows.select("month", "n", F.concat(F.lit("## "), "month", F.lit("\n"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("- [["), x["title"], F.lit("]] "), x["date"])), "\n")).alias("markdown"))
