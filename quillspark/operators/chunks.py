"""Chunks of documents for retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators from the coarsest to the finest.
SEPARATORS = ("\n\n", "\n", "。", ". ", " ", "")


def split_text(text: str, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that serves, each overlapping the one before."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    parts = text.split(sep) if sep else list(text)
    out, now = [], []

    def width(extra: int = 0) -> int:
        return sum(map(len, now)) + len(sep) * max(0, len(now) - 1) + extra

    def close() -> None:
        joined = sep.join(now).strip()
        if joined and (not out or out[-1] != joined):
            out.append(joined)

    for part in parts:
        if len(part) > size and finer:
            close()
            now = []
            out += split_text(part, size, overlap, finer)
            continue
        if now and width(len(sep) + len(part)) > size:
            close()
            while now and (width() > overlap or width(len(sep) + len(part)) > size):
                now.pop(0)
        now.append(part)
    close()
    return out


def chunk(sections: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, section_id, idx, id (md5 of the three) and content; sections: doc_id, section_id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, k, c) for d, s, t in zip(b["doc_id"], b["section_id"], b["text"]) if isinstance(t, str) for k, c in enumerate(split_text(t.strip(), size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "section_id", "idx", "content"])

    text = sections.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("section_id").cast("string").alias("section_id"), "text")
    return text.mapInPandas(run, "doc_id string, section_id string, idx int, content string").withColumn("id", F.md5(F.concat_ws("::", "doc_id", "section_id", F.col("idx").cast("string"))))


def hub_and_spokes(docs: DataFrame, least_lines: int = 200) -> DataFrame:
    """Documents of many lines as a hub that links to one document for each `## ` section; others as they are."""
    lines = F.size(F.split("body", "\n"))
    long = docs.where(lines >= least_lines).select("path", F.split("body", r"(?m)^(?=## )").alias("parts"))
    stem = F.regexp_replace("path", r"\.md$", "")
    parts = long.where(F.size("parts") > 1).select("path", stem.alias("stem"), F.posexplode("parts").alias("pos", "part"))
    spokes = parts.where("pos > 0").select(F.concat("stem", F.lit("__"), F.lpad(F.col("pos").cast("string"), 2, "0"), F.lit(".md")).alias("path"), F.col("part").alias("body"))
    names = parts.where("pos > 0").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- [["), F.regexp_extract("stem", "[^/]*$", 0), F.lit("__"), F.lpad(F.col("pos").cast("string"), 2, "0"), F.lit("]]")).alias("line")))).alias("l"))
    hubs = parts.where("pos = 0").join(names, "path").select("path", F.concat("part", F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))
    rest = docs.select("path", "body").join(hubs.select("path"), "path", "left_anti")
    return hubs.unionByName(spokes).unionByName(rest)
