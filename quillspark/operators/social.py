"""Feeds over posts and follow edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feed(posts: DataFrame, follows: DataFrame, recent: int = 20, trending: int = 10, limit: int = 15) -> DataFrame:
    """reader, post_id and place: the newest posts of those a reader follows, then what is trending, without repeats.

    posts: post_id, author_id, seq, likes; follows: reader, author_id.
    """
    # No reader sees more than `recent` posts of one author, so only those are joined.
    newest = posts.withColumn("_n", F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("seq"), F.desc("post_id")))).where(F.col("_n") <= recent)
    own = newest.join(follows, "author_id").where("reader <> author_id")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("reader").orderBy(F.desc("seq"), F.desc("post_id")))).where(F.col("_n") <= recent)
    top = posts.orderBy(F.desc("likes"), "seq", "post_id").limit(trending).select("post_id", F.row_number().over(Window.orderBy(F.desc("likes"), "seq", "post_id")).alias("at"))
    hot = follows.select("reader").distinct().join(F.broadcast(top)).select("reader", "post_id", (F.col("at") + 1_000_000_000).cast("long").alias("at"))  # at most `trending` rows
    both = own.select("reader", "post_id", (-F.col("_n")).cast("long").alias("at")).union(hot)
    once = both.groupBy("reader", "post_id").agg(F.min("at").alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("reader").orderBy("at", "post_id")).cast("long")).where(F.col("place") <= limit).select("reader", "post_id", "place")
