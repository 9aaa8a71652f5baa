"""Wikilinks to documents when names repeat: the nearest of all documents that bear a name, without pairing links with candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import slug

#: What an explicit folder, the same folder and each shared leading folder are worth.
EXPLICIT, SAME, SHARED = 5000, 1000, 10


def parts(folder: Column) -> Column:
    """Folders of a path, lower case; none for the root or null."""
    return F.filter(F.split(F.lower(F.translate(F.coalesce(folder, F.lit("")), "\\", "/")), "/"), lambda x: x != "")


def _heads(segs: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))


def _tails(segs: Column) -> Column:
    """Every trailing run of folders, and null: no folder asked for."""
    runs = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda n: F.nullif(F.array_join(F.slice(segs, F.size(segs) - n + 1, n), "/"), F.lit("")))
    return F.array_distinct(runs)


def nearest_index(docs: DataFrame) -> DataFrame:
    """name, dirs, head, whole, depth, doc_id: for each name, asked folders and shared leading folders the best document.

    Of documents under the same head the shallowest scores highest, then the smallest path; `whole` rows hold a
    folder's own documents. A document gives one row for each head and tail of its folder, combined before the shuffle.
    """
    segs = docs.select("doc_id", F.lower(F.regexp_replace("filename", r"(?i)\.md$", "")).alias("name"), F.concat_ws("/", "folder", "filename").alias("path"), parts(F.col("folder")).alias("segs"))
    keyed = segs.withColumn("dirs", F.explode(_tails(F.col("segs")))).withColumn("depth", F.size("segs"))
    # Values are sent along, so that an explode doesn't carry the document's other columns.
    heads = keyed.select("name", "dirs", "depth", "path", "doc_id", F.explode(_heads(F.col("segs"))).alias("head"), F.lit(False).alias("whole"))
    own = keyed.select("name", "dirs", "depth", "path", "doc_id", F.array_join("segs", "/").alias("head"), F.lit(True).alias("whole"))
    best = F.min(F.struct("depth", "path", "doc_id"))
    return heads.unionByName(own).groupBy("name", "dirs", "head", "whole").agg(best.alias("b")).select("name", "dirs", "head", "whole", "b.depth", "b.path", "b.doc_id")


def nearest(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked: name, dirs (null: none), folder. Gives each distinct row of it the doc_id of the best candidate, if any.

    The score of a candidate is EXPLICIT if its folder ends in dirs, SAME in the same folder, SHARED for each leading
    folder in common, less its depth; ties go to the smaller path. A candidate seen from a shorter head than it shares
    scores too little there and in full at its own head, so the maximum over heads is exact, and each lookup is an
    equality on a key that the index holds once: a name that very many documents bear costs no more than a rare one.
    """
    rows = asked.select("name", "dirs", "folder").distinct().withColumn("segs", parts(F.col("folder")))
    tails = F.array_distinct(F.array(F.col("dirs"), F.lit(None).cast("string")))
    rows = rows.withColumn("_tail", F.explode(tails))
    looked = rows.select("name", "dirs", "folder", "_tail", F.posexplode(_heads(F.col("segs"))).alias("_shared", "_head"), F.lit(False).alias("_whole"))
    same = rows.select("name", "dirs", "folder", "_tail", F.size("segs").alias("_shared"), F.array_join("segs", "/").alias("_head"), F.lit(True).alias("_whole"))
    index = nearest_index(docs).select(F.col("name").alias("_name"), F.col("dirs").alias("_dirs"), "head", "whole", "depth", "path", "doc_id")
    met = looked.unionByName(same).join(index, (F.col("name") == F.col("_name")) & F.col("_tail").eqNullSafe(F.col("_dirs")) & (F.col("_head") == F.col("head")) & (F.col("_whole") == F.col("whole")))
    score = F.when(F.col("_tail").isNotNull(), EXPLICIT).otherwise(0) + F.when(F.col("whole"), SAME).otherwise(0) + SHARED * F.col("_shared") - F.col("depth")
    return met.groupBy("name", "dirs", "folder").agg(F.min(F.struct((-score).alias("s"), "path", "doc_id")).alias("b")).select("name", "dirs", "folder", F.col("b.doc_id").alias("doc_id"))


def resolve(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links: src, link. docs: doc_id (string), folder, filename, sections (ids). Returns src, link, dst and how.

    `how` tells which step met the link: id, section, name, subpath or phantom; dst of a phantom is `_phantom_` and the
    target's slug. Links to oneself and empty ones are left out; repeated links stay. Without a document every link is a phantom.
    """
    target = F.trim(F.regexp_replace(F.trim(F.regexp_replace("link", "[|#](?s:.*)$", "")), r"[/\\]+$", ""))
    rows = links.select("src", "link", target.alias("_t")).where("_t <> ''")
    home = docs.select(F.col("doc_id").alias("src"), "folder").dropDuplicates(["src"])
    rows = rows.join(home, "src", "left")
    ids = docs.select(F.col("doc_id").alias("_t"), F.col("doc_id").alias("_id")).dropDuplicates(["_t"])
    by_section = docs.select(F.explode("sections").alias("_t"), "doc_id").groupBy("_t").agg(F.max("doc_id").alias("_section"))
    segs = F.filter(F.transform(F.split(F.translate(F.lower("_t"), "\\", "/"), "/"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.join(ids, "_t", "left").join(by_section, "_t", "left").withColumn("_segs", segs)
    deep = F.size("_segs") > 1
    # A name with a slash bears no document, as file names have none: whole targets and subpaths need one lookup.
    rows = rows.withColumns({"name": F.when(deep, F.element_at("_segs", -1)).otherwise(F.lower("_t")), "dirs": F.when(deep, F.array_join(F.slice("_segs", F.lit(1), F.size("_segs") - 1), "/"))})
    found = nearest(rows.where("_id is null and _section is null"), docs).select(F.col("name").alias("_n"), F.col("dirs").alias("_d"), F.col("folder").alias("_f"), F.col("doc_id").alias("_near"))
    met = rows.join(found, (F.col("name") == F.col("_n")) & F.col("dirs").eqNullSafe(F.col("_d")) & F.col("folder").eqNullSafe(F.col("_f")), "left")
    how = F.when(F.col("_id").isNotNull(), "id").when(F.col("_section").isNotNull(), "section").when(F.col("_near").isNotNull(), F.when(deep, "subpath").otherwise("name")).otherwise("phantom")
    dst = F.coalesce("_id", "_section", "_near", F.concat(F.lit("_phantom_"), slug(F.col("_t"))))
    return met.select("src", "link", dst.alias("dst"), how.alias("how")).where("src <> dst")
