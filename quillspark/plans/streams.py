"""Streams over the given tables, run to their end, and what a batch in DuckDB SQL makes of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.session import table
from quillspark.streaming import stateful
from quillspark.streaming.runs import finished, source

HOUR, DAY = 3_600_000, 86_400_000
LATE_MINUTES = 10


def _events(spark, d):
    return source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def reaction_stream(spark, d):
    """A user's events as saves of one document whose version is the event's type: reactions at most every six hours, the last deferred one fired by a timer."""
    saves = _events(spark, d).select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("etag"), "ts")
    return finished(stateful.reactions(saves, 6 * HOUR, f"{LATE_MINUTES} minutes"), "reactions")


def version_stream(spark, d):
    """Orders as changes of a customer's document; orders from 1996 on belong to a second generation."""
    changes = source(spark, d, "orders").select(
        F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), F.when(F.year("o_orderdate") >= 1996, 2).otherwise(1).cast("long").alias("generation"), F.col("o_orderpriority").alias("etag"), (F.col("o_orderstatus") == "F").alias("deleted")
    )
    return finished(stateful.versions(changes), "versions")


def raised_pairs(spark, d):
    """Errors as findings about a user and a number; each pair is raised at most once in seven days."""
    found = _events(spark, d).where("event_type = 'error'").select(F.col("user_id").alias("path"), (F.get_json_object("props", "$.k").cast("long") % 10).alias("other"), F.unix_millis("ts").alias("at"))
    return finished(stateful.raised(found, 7 * DAY), "raised", once=True)


def attributed_purchases(spark, d):
    """Purchases with the user's views of the two hours before: a join of two streams."""
    pick = lambda kind: _events(spark, d).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")
    return finished(stateful.attributed(pick("view"), pick("purchase"), "user_id", "2 hours", "1 hour"), "attributed")


def delivered_events(spark, d):
    """Events of which every third is delivered twice, by type."""
    rows = _events(spark, d)
    once = finished(stateful.delivered_once(rows.unionByName(rows.where("event_id % 3 = 0")), ["event_id"], "1 hour"), "delivered")
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def external_deletes(spark, d):
    """Errors as notices that a part is gone; parts larger than 25 are there again."""
    notices = _events(spark, d).where("event_type = 'error'").select(F.get_json_object("props", "$.k").cast("long").alias("path"), F.md5("props").alias("hash"), "ts")
    listing = table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_size")
    return finished(stateful.tombstones(notices, listing, F.col("p_size") > 25), "deletes").select("path", "hash").distinct()


QUERIES = {f.__name__: f for f in (reaction_stream, version_stream, raised_pairs, attributed_purchases, delivered_events, external_deletes)}

ORACLES = {
    # A state machine, one row of a user after the other.
    "reaction_stream": f"""WITH RECURSIVE e AS (SELECT user_id AS path, event_id AS seq, event_type AS own, (epoch_us(ts) // 1000) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n,
  max(event_id) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met FROM events),
 r AS (SELECT DISTINCT path, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BIGINT AS tm, NULL::VARCHAR AS etag, NULL::BIGINT AS last, NULL::BIGINT AS w, NULL::VARCHAR AS w_etag, NULL::VARCHAR AS act, NULL::BIGINT AS fired, NULL::BIGINT AS fired_at, NULL::BIGINT AS gone FROM e
  UNION ALL SELECT path, n, seq, tm, CASE WHEN act = 'reacted' THEN own ELSE etag END, CASE WHEN act = 'reacted' THEN tm ELSE last END, CASE WHEN act = 'deferred' THEN seq ELSE w END, CASE WHEN act = 'deferred' THEN own ELSE w_etag END, act, fired, fired_at, CASE WHEN act = 'deferred' THEN w END
   FROM (SELECT *, CASE WHEN seq <= met THEN 'dropped' WHEN own = etag THEN 'seen' WHEN last IS NULL OR tm >= last + {6 * HOUR} THEN 'reacted' ELSE 'deferred' END AS act
    FROM (SELECT path, n, seq, tm, own, met, CASE WHEN f THEN r_w_etag ELSE r_etag END AS etag, CASE WHEN f THEN r_last + {6 * HOUR} ELSE r_last END AS last, CASE WHEN NOT f THEN r_w END AS w, CASE WHEN NOT f THEN r_w_etag END AS w_etag, CASE WHEN f THEN r_w END AS fired, CASE WHEN f THEN r_last + {6 * HOUR} END AS fired_at
     FROM (SELECT e.*, r.etag AS r_etag, r.last AS r_last, r.w AS r_w, r.w_etag AS r_w_etag, coalesce(r.w IS NOT NULL AND e.tm >= r.last + {6 * HOUR}, false) AS f FROM r JOIN e ON e.path = r.path AND e.n = r.n + 1)))),
 o AS (SELECT path, seq, tm, act AS action FROM r WHERE n > 0 UNION ALL SELECT path, fired, fired_at, 'reacted late' FROM r WHERE fired IS NOT NULL UNION ALL SELECT path, gone, tm, 'superseded' FROM r WHERE gone IS NOT NULL
 UNION ALL SELECT path, w, last + {6 * HOUR}, 'reacted late' FROM (SELECT * FROM r QUALIFY n = max(n) OVER (PARTITION BY path)) WHERE w IS NOT NULL AND last + {6 * HOUR} <= (SELECT max(tm) FROM e) - {LATE_MINUTES * 60_000})
 SELECT path, seq, tm AS "at", action FROM o""",
    "version_stream": """WITH e AS (SELECT o_custkey AS path, o_orderkey AS seq, CASE WHEN year(o_orderdate) >= 1996 THEN 2 ELSE 1 END::BIGINT AS generation, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS own, o_orderstatus = 'F' AS gone FROM orders),
 m AS (SELECT *, max(generation) OVER (PARTITION BY path ORDER BY seq) AS most FROM e), k AS (SELECT *, lag(own) OVER (PARTITION BY path, generation, generation = most ORDER BY seq) AS before FROM m)
 SELECT path, seq, generation, CASE WHEN generation < most THEN 'stale' WHEN own = before THEN 'echo' WHEN gone THEN 'delete' ELSE 'put' END AS action FROM k""",
    "raised_pairs": f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS path, ((props->>'$.k')::BIGINT % 10)::VARCHAR AS other, (epoch_us(ts) // 1000) AS tm FROM events WHERE event_type = 'error'),
 r AS (SELECT path, other, min(tm) AS tm FROM e GROUP BY 1, 2 UNION ALL SELECT r.path, r.other, min(e.tm) AS tm FROM r JOIN e ON e.path = r.path AND e.other = r.other AND e.tm >= r.tm + {7 * DAY} GROUP BY 1, 2) SELECT path, other, tm AS "at" FROM r""",
    "attributed_purchases": "SELECT b.user_id, a.event_id AS cause, b.event_id AS effect FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOURS WHERE a.event_type = 'view' AND b.event_type = 'purchase'",
    "delivered_events": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "external_deletes": "SELECT DISTINCT (props->>'$.k')::BIGINT AS path, md5(props) AS hash FROM events WHERE event_type = 'error' AND (props->>'$.k')::BIGINT NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)",
}
