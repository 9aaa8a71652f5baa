"""Searches without an index, and the fusion and re-ranking of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import occurrences


#: Vectors that a block of queries is scored against at a time.
PIECE = 1024


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def substring_tfidf(docs: DataFrame, query: list[str], title: Column) -> DataFrame:
    """Substring TF-IDF: a term in the title adds 3 idf, each occurrence in the body half an idf, up to 3."""
    low = docs.select("doc_id", F.lower(title).alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    stats = low.agg(F.count("*").alias("n"), *[F.count_if(F.contains("body", F.lit(q))).alias(f"df{k}") for k, q in enumerate(query)]).first()
    parts = []
    for k, q in enumerate(query):
        weight = F.log(1 + (F.lit(stats["n"]) - stats[f"df{k}"] + 0.5) / (F.lit(stats[f"df{k}"]) + 0.5))
        parts.append(weight * (F.when(F.contains("title", F.lit(q)), 3.0).otherwise(0.0) + F.least(0.5 * occurrences(F.col("body"), F.lit(q)), F.lit(3.0))))
    return low.select("doc_id", _sum(parts).alias("score")).where("score > 0")


def direct(docs: DataFrame, query: list[str], name: Column) -> DataFrame:
    """Coverage of the query in the name (0.6) and the body (0.4); a name hit lifts the score to 0.3 + 0.7 s."""
    low = docs.select("doc_id", F.lower(name).alias("name"), F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    share = lambda c: _sum([F.contains(c, F.lit(q)).cast("int") for q in query]) / len(query)
    s = 0.6 * share(F.col("name")) + 0.4 * share(F.col("body"))
    return low.select("doc_id", F.when(share(F.col("name")) > 0, 0.3 + 0.7 * s).otherwise(s).alias("score")).where("score > 0")


def keyword(docs: DataFrame, query: list[str], heading: Column) -> DataFrame:
    """Heading hits 0.3, body hits 0.1 (1 + ln n), summed and capped at 1; then 0.6 s + 0.4 coverage."""
    low = docs.select("doc_id", F.lower(heading).alias("heading"), F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    n = [occurrences(F.col("body"), F.lit(q)) for q in query]
    s = _sum([F.when(F.contains("heading", F.lit(q)), 0.3).otherwise(0.0) + F.when(c > 0, 0.1 * (1 + F.log(c.cast("double")))).otherwise(0.0) for q, c in zip(query, n)])
    cover = _sum([(F.contains("heading", F.lit(q)) | (c > 0)).cast("int") for q, c in zip(query, n)]) / len(query)
    return low.select("doc_id", (0.6 * F.least(s, F.lit(1.0)) + 0.4 * cover).alias("score"), cover.alias("cover")).where("cover > 0").select("doc_id", "score")


def rank(scored: DataFrame, k: int) -> DataFrame:
    """doc_id and rank (from 1) of the k best; the limit comes first, so the window sees k rows."""
    best = scored.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long").alias("rank"))


def fuse(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    joined = a.withColumnRenamed("rank", "_a").join(b.withColumnRenamed("rank", "_b"), "doc_id", "full_outer")
    return joined.select("doc_id", (part("_a") + part("_b")).alias("score"), F.col("_a").isNotNull().alias("lexical"), F.col("_b").isNotNull().alias("semantic"))


def hotness(scored: DataFrame, seen: DataFrame, now: Column, half_life_days: float = 7.0) -> DataFrame:
    """0.85 of the normalised score and 0.15 of use: sigmoid(ln(1 + n)) halved every seven days since the last use.

    scored: doc_id, score; seen: doc_id, n, last (timestamp).
    """
    joined = scored.join(seen, "doc_id", "left")
    most = scored.agg(F.max("score").alias("most"))
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 86400.0
    use = F.coalesce((1 / (1 + F.exp(-F.log1p("n")))) * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life_days), F.lit(0.0))
    return joined.join(F.broadcast(most)).select("doc_id", (F.col("most") * (0.85 * F.col("score") / F.col("most") + 0.15 * use)).alias("score"))  # one row


def deduplicate_versions(hits: DataFrame, name: Column) -> DataFrame:
    """Of documents whose names differ in version marks alone the best: final first, then the higher version."""
    base = F.trim(F.regexp_replace(F.lower(name), r"[ _-]*(v\d+(\.\d+)?|final|최종)", ""))
    version = F.coalesce(F.nullif(F.regexp_extract(F.lower(name), r"v(\d+(\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))
    order = Window.partitionBy("_base").orderBy(F.lower(name).rlike("final|최종").desc(), version.desc(), "doc_id")
    return hits.withColumn("_base", base).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_base", "_n")


def best_section(sections: DataFrame, query: list[str]) -> DataFrame:
    """doc_id, pos and hits: each document's section (doc_id, pos, text) with the most query terms, the first among equals.

    Sections without a term are left out before anything is shuffled; null texts hold no term.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((F.contains(low, F.lit(q)).cast("long") for q in sorted(set(query))), F.lit(0).cast("long"))
    found = sections.select("doc_id", "pos", hits.alias("hits")).where("hits > 0")
    return found.groupBy("doc_id").agg(F.max(F.struct("hits", (-F.col("pos")).alias("back"))).alias("b")).select("doc_id", (-F.col("b.back")).alias("pos"), F.col("b.hits").alias("hits"))


def blend(one: DataFrame, other: DataFrame, share: float = 0.3) -> DataFrame:
    """doc_id and score of two lists of hits with distinct ids: the larger score plus a share of the smaller where both have one."""
    both = one.select("doc_id", "score").unionByName(other.select("doc_id", "score"))
    less = F.when(F.count("score") == 2, share * F.min("score")).otherwise(0.0)
    return both.groupBy("doc_id").agg((F.max("score") + less).alias("score"))


def within_budget(rows: DataFrame, group: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """The leading rows of each group whose running size stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def _by_blocks(vectors: DataFrame, queries: DataFrame, block: int, columns: list[str], emit, schema: str) -> DataFrame:
    """emit(query ids, rows of the batch, scores) over every block of queries and every batch of vectors.

    A score is the cosine; a vector's score to itself is -2.
    """
    import numpy as np

    rows = queries.select("vec_id", "embedding").where("embedding is not null").orderBy("vec_id").toLocalIterator()
    found = []

    def search(own):
        ids = np.array([r["vec_id"] for r in own], dtype=np.int64)
        q = np.array([r["embedding"] for r in own], dtype=np.float64) if own else np.zeros((0, 1))
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches):
            # Scores take a block of queries times a piece of a batch, whatever a batch holds.
            for b in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
                b = b.filter(b.column("embedding").is_valid())
                if not b.num_rows or not len(ids):
                    continue
                x = np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                s = q @ x.T
                s[ids[:, None] == b.column("vec_id").to_numpy(zero_copy_only=False)[None, :]] = -2
                yield emit(ids, b, s)

        return vectors.select("vec_id", "embedding", *columns).mapInArrow(run, schema)

    own = []
    for r in rows:
        own.append(r)
        if len(own) == block:
            found.append(search(own))
            own = []
    found.append(search(own)) if own or not found else None
    return reduce(DataFrame.unionByName, found)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024, least: float = 0.0) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest (cosine above `least`) of each query, other than itself.

    Scores are rounded to 6 places and ties go by id, so a batch gives all vectors that can round to its k-th score.
    """
    import numpy as np
    import pyarrow as pa

    def emit(ids, b, s):
        near = s > least - 1e-6
        if s.shape[1] > k:
            near &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None] - 1e-6
        row, at = np.nonzero(near & (s > -1.5))
        return pa.record_batch([pa.array(ids[row]), b.column("vec_id").take(pa.array(at)).cast(pa.int64()), pa.array(s[row, at])], names=["query_id", "vec_id", "score"])

    scored = _by_blocks(vectors, queries, block, [], emit, "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6)).where(F.col("score") > least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def vector_pool(vectors: DataFrame, queries: DataFrame, group: str, block: int = 1024, least: float = 0.0) -> DataFrame:
    """query_id, group and score: the best cosine above `least` of each group of all vectors, for each query.

    Maxima are taken in each batch, so what is shuffled are groups, not vectors.
    """
    import numpy as np
    import pyarrow as pa

    def emit(ids, b, s):
        coded = b.column(group).dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        best = np.maximum.reduceat(s[:, order], np.searchsorted(code[order], np.arange(len(coded.dictionary))), axis=1)
        row, at = np.nonzero(best > max(least - 1e-6, -1.5))
        return pa.record_batch([pa.array(ids[row]), coded.dictionary.take(pa.array(at)), pa.array(best[row, at])], names=["query_id", group, "score"])

    kind = vectors.schema[group].dataType.simpleString()
    found = _by_blocks(vectors, queries, block, [group], emit, f"query_id long, `{group}` {kind}, score double")
    return found.groupBy("query_id", group).agg(F.round(F.max("score"), 6).alias("score")).where(F.col("score") > least)
