"""Markdown documents: frontmatter, sections and normalised fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import image_embeds, link_key, slug, strip_frontmatter, unique_ids, wikilinks


def frontmatter(raw: Column) -> Column:
    """Scalars and lists of the leading --- block as a map of strings; lists are joined by commas."""
    block = F.regexp_extract(raw, r"\A---\n((?s:.*?))\n---", 1)
    # A block list's items are put on their key's line first.
    one_line = F.regexp_replace(F.regexp_replace(block, r"\n\s*-\s+", ","), r":[ \t]*,", ": ")
    lines = F.filter(F.split(one_line, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    unquote = lambda c: F.regexp_replace(F.trim(c), "^[\"'\\[]+|[\"'\\]]+$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([\w-]+):", 1)).alias("key"), unquote(F.regexp_replace(x, r"^[\w-]+:", "")).alias("value")))
    first = F.filter(pairs, lambda p: p["value"] != "")
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(first, lambda p: p["key"])), lambda k: F.struct(k.alias("key"), F.filter(first, lambda p: p["key"] == k)[0]["value"].alias("value"))))


def listed(value: Column) -> Column:
    """A comma-separated field as an array of trimmed, non-empty strings."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", "")))
    return F.filter(parts, lambda x: x != "")


def parse(files: DataFrame) -> DataFrame:
    """Files (path, content, mtime) to documents; ids are made unique in path order."""
    raw = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n")
    read = files.select("path", "mtime", raw.alias("raw")).withColumns({"frontmatter": frontmatter(F.col("raw")), "body": strip_frontmatter(F.col("raw"))})
    get = lambda k: F.col("frontmatter")[k]
    file = F.regexp_extract("path", "[^/]*$", 0)
    return read.select(
        "path",
        "mtime",
        unique_ids(slug(F.col("path")), F.col("path"), Window).alias("doc_id"),
        file.alias("filename"),
        F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/$", "").alias("folder"),
        link_key(file).alias("key"),
        F.coalesce(get("title"), F.regexp_replace(file, "\\.md$", "")).alias("title"),
        F.coalesce(get("date"), F.lit("")).alias("date"),
        F.lower(get("type")).alias("type"),
        F.lower(get("status")).alias("status"),
        get("superseded_by").alias("superseded_by"),
        F.when(get("graph_weight").isin("low", "skip"), get("graph_weight")).alias("graph_weight"),
        F.coalesce(F.lower(get("speaker")), F.lit("unknown")).alias("speaker"),
        listed(get("tags")).alias("tags"),
        listed(get("related")).alias("related"),
        F.array_distinct(F.concat(wikilinks(F.col("body")), F.transform(listed(get("links")), lambda x: F.regexp_replace(x, r"[\[\]]", "")))).alias("links"),
        image_embeds(F.col("body")).alias("images"),
        "body",
    )


def sections(docs: DataFrame, levels: str = "1,3") -> DataFrame:
    """doc_id, pos, section_id, heading, body and links of each section; text before the first heading is `(intro)`."""
    pattern = rf"(?m)^(?=#{{{levels}}}\s)"
    parts = docs.select("doc_id", F.posexplode(F.filter(F.split("body", pattern), lambda s: F.trim(s) != "")).alias("pos", "part"))
    head = F.trim(F.regexp_extract("part", rf"\A#{{{levels}}}\s+([^\n]*)", 1))
    has = F.col("part").rlike(rf"\A#{{{levels}}}\s")
    out = parts.select("doc_id", "pos", F.when(has, head).otherwise("(intro)").alias("heading"), F.regexp_replace(F.when(has, F.regexp_replace("part", r"\A[^\n]*\n?", "")).otherwise(F.col("part")), r"\A\s+|\s+\z", "").alias("body"))
    base = F.concat_ws("_", "doc_id", F.regexp_replace(F.regexp_replace(F.lower("heading"), r"\s+", "_"), "[^a-z0-9_가-힣]", ""))
    n = F.row_number().over(Window.partitionBy("doc_id", base).orderBy("pos"))
    return out.withColumns({"section_id": F.when(n == 1, base).otherwise(F.concat_ws("_", base, n.cast("string"))), "links": wikilinks(F.col("body"))})
