"""Queries over markdown notes laid out from the documents: parsing, sections, link graph, findings, recall and rewriting.

As in `vault`, the layout is SQL that both engines read, and what is asked of it is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import markdown
from quillspark.operators import chunks, graph, lint, recall, rewrite, search, surroundings
from quillspark.session import cut, table

_K = "CAST(doc_id AS STRING)"
HALF = "'n' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)"
LATER = "'n' || CAST(doc_id + 3 AS STRING)"
GONE = "'Gone ' || CAST(doc_id % 5 AS STRING)"
PATH = f"CASE WHEN doc_id % 23 = 0 THEN '_reports/n' || {_K} WHEN doc_id % 10 = 0 THEN lang || '_n' || CAST(doc_id + 1 AS STRING) ELSE lang || '/n' || {_K} END || '.md'"
HEAD = [
    "'---'", f"'title: T' || {_K}", "'tags: [' || lang || ', ' || source || ']'", "'status: Active'", "CASE doc_id % 6 WHEN 0 THEN 'graph_weight: skip' WHEN 1 THEN 'graph_weight: high' ELSE 'x: 1' END",
    "CASE WHEN doc_id % 4 = 0 THEN 'speaker: Ann' ELSE 'kind: \"a\"' END", "'date: 2024-0' || CAST(1 + doc_id % 9 AS STRING) || '-05'", "'---'",
]
BODY = [
    "'# Head ' || CAST(doc_id % 5 AS STRING)", f"'About [[' || {HALF} || ']] and [[' || {LATER} || '|alias]], ![[pic' || CAST(doc_id % 3 AS STRING) || '.png]]'",
    "'## Part'", "'some words, more words'", "'## Part'", f"CASE WHEN doc_id % 7 < 5 THEN '[[' || {GONE} || ']]' ELSE 'plain' END", "'### Deep One'", f"'[[n' || {_K} || '#x]]'",
]


def lined(lines: list[str]) -> str:
    return " || chr(10) || ".join(lines)


CONTENT = lined(HEAD + BODY)
MTIME = "CAST(1700000000000 + (doc_id % 400) * 86400000 AS BIGINT)"
NOW = 1_700_000_000_000 + 400 * 86_400_000
KNOWN = "doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL"


def notes(spark, d) -> DataFrame:
    """Parsed notes."""
    return markdown.parse(table(spark, d, "documents").where(KNOWN).selectExpr(f"{PATH} AS path", f"{CONTENT} AS content", f"{MTIME} AS mtime"))


def _graph(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes outside the reports, their edges and phantoms, stored."""
    docs = notes(spark, d).where("folder <> '_reports'")
    edges, phantoms = graph.link_graph(docs)
    return docs, cut(edges), cut(phantoms)


def parsed_notes(spark, d):
    joined = lambda c: F.array_join(c, ";").alias(c)
    return notes(spark, d).select("path", "doc_id", "folder", "key", "title", "date", "status", "graph_weight", "speaker", joined("tags"), joined("links"), joined("images"), F.length("body").alias("n_body"))


def note_sections(spark, d):
    return markdown.sections(notes(spark, d)).select("doc_id", "pos", "section_id", "heading", "body", F.size("links").alias("links"))


def note_chapters(spark, d):
    """Sections of second-level headings alone."""
    return markdown.sections(notes(spark, d), "2").groupBy("heading", "section_id").agg(F.count("*").alias("n"))


def note_links(spark, d):
    return _graph(spark, d)[1]


def note_phantoms(spark, d):
    return _graph(spark, d)[2]


def note_degrees(spark, d):
    return graph.degrees(_graph(spark, d)[1])


def _plain(findings: DataFrame) -> DataFrame:
    return findings.select("rule", "severity", "doc_id", F.round("score", 6).alias("score"))


def lint_phantoms(spark, d):
    return _plain(lint.phantom_hot(_graph(spark, d)[2], 3))


def lint_orphans(spark, d):
    docs, edges, phantoms = _graph(spark, d)
    # Half of the links taken away, so that there are orphans.
    return _plain(lint.orphans(docs, edges.where("endswith(dst, '1')"), phantoms))


def lint_stale_hubs(spark, d):
    docs, edges, _ = _graph(spark, d)
    ranks = graph.degrees(edges).select("node", F.col("in_degree").alias("score"))
    return _plain(lint.stale_hubs(docs, ranks, NOW, lint.LintParams()))


def lint_thin_bridges(spark, d):
    """Documents of few links into another language, but those that are known cuts."""
    docs, edges, _ = _graph(spark, d)
    some = edges.where("endswith(src, '7') and endswith(dst, '3')")
    member = docs.select(F.col("doc_id").alias("node"), F.regexp_extract("doc_id", "^[a-z]+", 0).alias("community"))
    return _plain(lint.thin_spof(some, member, docs.where("endswith(doc_id, '17')").select("doc_id")))


def lint_near_duplicates(spark, d):
    docs, edges, _ = _graph(spark, d)
    pairs = edges.select(F.col("dst").alias("a"), F.concat("src", F.lit("x")).alias("b"), F.lit(0.95).alias("similarity")).union(edges.select("src", "dst", F.lit(0.99))).union(edges.select(F.col("dst"), F.concat("src", F.lit("y")), F.lit(0.5)))
    return _plain(lint.near_duplicates(pairs, edges, 0.92))


def lint_cluster_drift(spark, d):
    rows = table(spark, d, "documents").where(KNOWN)
    return _plain(lint.cluster_drift(rows.select(F.col("doc_id").alias("node"), F.col("lang").alias("community")), rows.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("node"), F.col("source").alias("community")), lint.LintParams()))


def findings_by_rule(spark, d):
    docs, edges, phantoms = _graph(spark, d)
    ranks = graph.degrees(edges).select("node", F.col("in_degree").alias("score"))
    found = lint.phantom_hot(phantoms, 3).unionByName(lint.orphans(docs, edges.where("endswith(dst, '1')"), phantoms)).unionByName(lint.stale_hubs(docs, ranks, NOW, lint.LintParams()))
    return surroundings.findings_count(found)


def recall_bundle(spark, d):
    """The longest five texts of the notes, and what lies around them."""
    docs, edges, _ = _graph(spark, d)
    rows = table(spark, d, "documents").where(KNOWN + " AND doc_id % 23 <> 0 AND doc_id % 10 <> 0")
    rows = rows.select(F.concat("lang", F.lit("_n"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("n_chars").cast("double").alias("score"), F.concat(F.lit("About "), "source").alias("title"), F.regexp_replace("text", "\n+", "\n").alias("body"))
    return recall.bundle(rows.select("doc_id", "score"), edges, rows, ["about", "src3"]).select("role", "place", "doc_id", "title", "score", "excerpt")


def version_survivors(spark, d):
    mark = F.when(F.col("doc_id") % 4 == 0, " v1").when(F.col("doc_id") % 4 == 1, "_v2.5").when(F.col("doc_id") % 4 == 2, " Final").otherwise("")
    hits = table(spark, d, "documents").where("doc_id is not null and doc_id % 3 <> 2").select("doc_id", F.concat(F.lit("plan"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("x"), mark).alias("name"))
    return search.deduplicate_versions(hits, F.col("name")).select("doc_id", "name")


def tag_peers(spark, d):
    rows = table(spark, d, "documents").where(KNOWN).select("doc_id", F.concat("lang", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("title"), F.array("lang", "source").alias("tags"))
    return rewrite.shared_tag_peers(rows).select("doc_id", F.array_join(F.transform("peers", lambda x: x.cast("string")), ",").alias("peers"))


def month_links(spark, d):
    return rewrite.month_index(notes(spark, d).select("date", "title"))


def hubs_and_spokes(spark, d):
    return chunks.hub_and_spokes(notes(spark, d).where("not endswith(path, '9.md')"), 5).unionByName(chunks.hub_and_spokes(notes(spark, d).where("endswith(path, '9.md')"), 50))


def keyword_links(spark, d):
    return rewrite.link_keywords(notes(spark, d).select("path", "body"), {"words": "Wordbook", "Head": "hub", "some": "some"})


def repaired_links(spark, d):
    body = F.concat(F.lit("see [["), F.col("lang"), F.lit("] or [[x [["), F.col("source"), F.lit("]] y]]"))
    return table(spark, d, "documents").where(KNOWN).select("doc_id", rewrite.repair_links(body).alias("body"))


def ghost_targets(spark, d):
    rows = table(spark, d, "documents").where(KNOWN)
    ghosts = rows.select(F.concat(F.lit("page"), F.col("doc_id").cast("string")).alias("ghost"))
    return rewrite.replace_ghosts(ghosts, rows.where("doc_id % 3 = 0").select(F.concat(F.lit("page"), F.col("doc_id").cast("string"), F.lit("a")).alias("key")))


QUERIES = {
    f.__name__: f
    for f in (
        parsed_notes, note_sections, note_chapters, note_links, note_phantoms, note_degrees, lint_phantoms, lint_orphans, lint_stale_hubs, lint_thin_bridges, lint_near_duplicates, lint_cluster_drift,
        findings_by_rule, recall_bundle, version_survivors, tag_peers, month_links, hubs_and_spokes, keyword_links, repaired_links, ghost_targets,
    )
}
