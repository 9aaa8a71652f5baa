"""What lies around a document, who wrote what, and search results joined with the rows that stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import paths


def signatures(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and element: a document's neighbours either way and its tags as #tag. Bookkeeping documents neither have nor are any."""
    team = docs.where(~paths.bookkeeping(F.col("path")))
    near = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst")
    ids = team.select(F.col("doc_id").alias("src"))
    near = near.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select(F.col("src").alias("doc_id"), F.col("dst").cast("string").alias("element"))
    tagged = team.select("doc_id", F.explode(F.transform("tags", lambda t: F.concat(F.lit("#"), F.lower(t)))).alias("element"))
    return near.union(tagged).distinct()


def similar(signature: DataFrame, doc_id, limit: int = 6) -> DataFrame:
    """doc_id, shared and score (Jaccard) of the documents whose signature is most like one document's.

    One document's own elements are joined with all, so that a tag of very many documents costs one row each.
    """
    own = signature.where(F.col("doc_id") == doc_id).select("element")
    size = own.agg(F.count("*").alias("_mine"))
    hit = own.withColumn("_hit", F.lit(True))
    rest = signature.where(F.col("doc_id") != doc_id).join(hit, "element", "left").groupBy("doc_id").agg(F.count("_hit").alias("shared"), F.count("*").alias("theirs"))
    scored = rest.where("shared > 0").join(F.broadcast(size)).withColumn("score", F.round(F.col("shared") / (F.col("theirs") + F.col("_mine") - F.col("shared")), 9))  # one row
    return scored.orderBy(F.desc("score"), F.desc("shared"), "doc_id").limit(limit).select("doc_id", "shared", "score")


def around(edges: DataFrame, docs: DataFrame, doc_id, limit: int = 6) -> DataFrame:
    """kind, other and score of one document: linked_from, links_to, proposal, remark and similar. Unscored kinds have null."""
    path = docs.where(F.col("doc_id") == doc_id).select(F.col("path").alias("_at"))
    back = edges.where(F.col("dst") == doc_id).select(F.col("src").alias("other")).distinct().join(docs.select(F.col("doc_id").alias("other"), "path"), "other")
    out = edges.where(F.col("src") == doc_id).select(F.col("dst").alias("other")).distinct().join(docs.select(F.col("doc_id").alias("other"), "path"), "other")
    team = ~paths.bookkeeping(F.col("path"))
    notes = docs.select(F.col("doc_id").alias("other"), paths.remarked_path(F.col("path")).alias("_at")).join(path, "_at", "left_semi")
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "other", F.lit(None).cast("double").alias("score"))
    found = [kind(back.where(team), "linked_from"), kind(out.where(team), "links_to"), kind(back.where(paths.proposal(F.col("path"))), "proposal"), kind(notes, "remark")]
    near = similar(signatures(edges, docs), doc_id, limit).select(F.lit("similar").alias("kind"), F.col("doc_id").alias("other"), "score")
    rows = near
    for f in found:
        rows = rows.unionByName(f)
    return rows


def remarks(docs: DataFrame) -> DataFrame:
    """doc_id, note_id and member of each note that lies at a document's path below a member's folder."""
    notes = docs.where(paths.member(F.col("path"))).select(F.col("doc_id").alias("note_id"), F.regexp_extract("path", "^[^/]+/([^/]+)/", 1).alias("member"), paths.remarked_path(F.col("path")).alias("path"))
    return notes.join(docs.select("doc_id", "path"), "path").select("doc_id", "note_id", "member")


def authored(people: DataFrame, rows: DataFrame) -> DataFrame:
    """people (sub ...) with docs: how many standing rows (author_sub, path, deleted) outside underscore folders each has written."""
    own = rows.where(~F.col("deleted") & ~F.startswith("path", F.lit("_"))).groupBy(F.col("author_sub").alias("sub")).agg(F.count("*").alias("docs"))
    return people.join(own, "sub", "left").na.fill(0, ["docs"])


def standing(hits: DataFrame, rows: DataFrame, key: str, visible: Column) -> DataFrame:
    """Hits whose document still stands and may be seen."""
    return hits.join(rows.where(~F.col("deleted") & visible).select(key), key, "left_semi")


def related(seeds: DataFrame, docs: DataFrame, top: int = 5, share: float = 0.7) -> DataFrame:
    """Seeds (doc_id, score, place) and the documents that the first of them name as related, at a share of their seed's score.

    A name meets file names with or without .md, in any case; of several the smallest id; a document that is a seed, or was
    named by an earlier seed, isn't added again. Returns doc_id, score and added.
    """
    first = seeds.where(F.col("place") <= top).join(docs.select("doc_id", "related"), "doc_id")
    named = first.select("place", "score", F.posexplode("related").alias("at", "raw"))
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), r"(?i)\.md$", ""))
    named = named.withColumn("key", key(F.regexp_replace("raw", r"^\[\[|\]\]$", ""))).where("key <> ''")
    names = docs.select(key(F.col("filename")).alias("key"), "doc_id").join(named.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    added = named.join(names, "key").join(seeds.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by("score", F.struct("place", "at")).alias("score"))
    return seeds.select("doc_id", "score", F.lit(False).alias("added")).union(added.select("doc_id", F.round(F.col("score") * share, 9), F.lit(True)))


def two_tracks(own: DataFrame, outside: DataFrame, top: int) -> DataFrame:
    """80 % of the places for one's own hits and 20 % (two at least) for outside references, twice as many of the former drawn; a document counts once.

    own, outside: doc_id, score. Returns doc_id, score and track; own hits come first.
    """
    best = lambda df, n, t: df.orderBy(F.desc("score"), "doc_id").limit(n).select("doc_id", "score", F.lit(t).alias("track"))
    a = best(own, 2 * max(1, round(top * 0.8)), "own")
    b = best(outside, max(2, round(top * 0.2)), "outside")
    return a.union(b.join(a.select("doc_id"), "doc_id", "left_anti"))


def metadata_filter(docs: DataFrame, query: str, generic: tuple[str, ...] = (), shortest: int = 3, floor: int = 50, share: float = 0.05) -> DataFrame:
    """Documents (speaker, tags) whose speaker or a telling tag is a word of the query.

    All documents stay if no word meets any, or if fewer than max(floor, share of all) would be left: one count decides, in one pass.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}_-]+"), lambda w: w != ""))
    telling = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: (F.length(t) >= shortest) & ~F.lower(t).isin(*generic) if generic else F.length(t) >= shortest)
    spoken = F.coalesce((F.lower("speaker") != "unknown") & F.array_contains(words, F.lower("speaker")), F.lit(False))
    hit = F.coalesce(spoken | F.exists(telling, lambda t: F.array_contains(words, F.lower(t))), F.lit(False))
    n, hits = docs.agg(F.count("*"), F.count_if(hit)).first()
    return docs.where(hit) if hits >= max(floor, -(-n * share // 1)) else docs


def ring(log: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The last row of each key, of the newest `limit` keys: an append-only log read as a ring with replacement."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return last.orderBy(F.desc(key)).limit(limit)


def before_live(versions: DataFrame, live: DataFrame, key: str, order: str, etag: str) -> DataFrame:
    """key, order and etag of the newest version whose content differs from the live row's; keys without one give no row."""
    now = live.select(key, F.col(etag).alias("_live"))
    older = versions.join(now, key).where(F.col(etag) != F.col("_live"))
    return older.groupBy(key).agg(F.max_by(F.struct(order, etag), order).alias("_v")).select(key, F.col(f"_v.{order}").alias(order), F.col(f"_v.{etag}").alias(etag))


def patched(base: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A table with changed rows put in place and removed keys taken out; a key in both is gone."""
    kept = base.join(changed.select(key).union(removed.select(key)), key, "left_anti")
    return kept.unionByName(changed.join(removed.select(key), key, "left_anti"))


def within_characters(rows: DataFrame, by: str, order: str, size: Column, budget: int, used: int = 0) -> DataFrame:
    """A group's rows in order, up to the first that would exceed the character budget."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_used", F.sum(size).over(w) + used).where(F.col("_used") <= budget).drop("_used")


def link_check(docs: DataFrame, images: DataFrame) -> DataFrame:
    """broken_images, broken_docs, bad_bangs, ok_images and files over documents (filename, body); images: name.

    Embeds of media that no image bears are broken; embeds of anything else are bad bangs; links to a name that no document bears are broken.
    """
    media = r"(?i)\.(png|jpe?g|gif|webp|svg|bmp|pdf)$"
    body = F.coalesce("body", F.lit(""))
    inner = lambda pattern, tail="": F.explode(F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, tail, "") if tail else x)))
    embeds = docs.select(inner(r"!\[\[([^\]]+)\]\]").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    linked = docs.select(inner(r"(?<!!)\[\[([^\]]+)\]\]", r"[|](?s:.*)$").alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    held = images.select("name").distinct().withColumn("_held", F.lit(True))
    stems = docs.select(F.regexp_replace("filename", r"(?i)\.md$", "").alias("name")).distinct().withColumn("_held", F.lit(True))
    one = lambda df, kind: df.select(kind.alias("kind"), "n")
    a = one(embeds.join(held, "name", "left"), F.when(~F.col("name").rlike(media), "bad_bangs").when(F.col("_held"), "ok_images").otherwise("broken_images"))
    b = one(linked.where(~F.col("name").rlike(media)).join(stems, "name", "left_anti"), F.lit("broken_docs"))
    files = docs.agg(F.count("*").alias("n")).select(F.lit("files").alias("kind"), "n")
    return a.unionByName(b).unionByName(files).groupBy("kind").agg(F.sum("n").alias("n"))


def findings_count(findings: DataFrame) -> DataFrame:
    """Findings by severity, by rule and in all."""
    return findings.groupingSets([[F.col("severity")], [F.col("rule")], []], F.col("severity"), F.col("rule")).agg(F.count("*").alias("n"))
