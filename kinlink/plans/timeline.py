"""Queries of what held when, over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline
from . import standins as S
from .catalogue import query


@query("""WITH r AS (SELECT user_id, ts, max(event_id) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id, ts)
SELECT l.event_id, l.user_id, r.last_error FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def last_error_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last error until then."""
    e = S.table(spark, sf_dir, "events")
    errors = e.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("last_error"))
    return timeline.as_of(e.select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", ["last_error"]).select("event_id", "user_id", "last_error")


@query("""WITH r AS (SELECT user_id % 7 AS k, floor(epoch(ts) / 86400) AS day, min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM events GROUP BY ALL
  UNION ALL SELECT 3, -1, min(epoch(ts)), max(epoch(ts)) FROM events),
s AS (SELECT user_id % 7 AS k, event_id, epoch(ts) - 30 AS a, epoch(ts) + event_id % 5000 AS b FROM events WHERE event_type = 'error')
SELECT r.k, CAST(r.day AS BIGINT) AS day, count(*) AS errors, sum(s.event_id)::BIGINT AS ids FROM r JOIN s ON r.k = s.k AND r.a <= s.b AND s.a <= r.b GROUP BY ALL""")
def overlapping_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (of a day, and one over the whole time) and the spans of errors that touch them."""
    at = F.col("ts").cast("double")
    e = S.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "event_type", (F.col("user_id") % 7).alias("k"), at.alias("at"))
    runs = e.groupBy("k", F.floor(F.col("at") / 86400).alias("day")).agg(F.min("at").alias("l_start"), F.max("at").alias("l_end"))
    whole = e.agg(F.lit(3).cast("long").alias("k"), F.lit(-1).cast("long").alias("day"), F.min("at").alias("l_start"), F.max("at").alias("l_end"))
    runs = runs.withColumn("k", F.col("k").cast("long")).unionByName(whole)
    spans = e.filter("event_type = 'error'").select(F.col("k").cast("long").alias("k"), "event_id", (F.col("at") - 30).alias("r_start"), (F.col("at") + F.col("event_id") % 5000).alias("r_end"))
    return timeline.overlapping(runs, spans, ["k"], 3600).groupBy("k", "day").agg(F.count("*").alias("errors"), F.sum("event_id").alias("ids"))


@query("""WITH r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'API_ERROR' WHEN event_type = 'view' THEN 'PENDING' WHEN event_type = 'click' THEN 'MATCH' ELSE 'REVIEW' END AS status, CAST(ts AS DATE) AS day, CASE WHEN user_id % 4 > 0 THEN user_id % 4 END AS team FROM events)
SELECT team, day, CAST(grouping(team, day) AS BIGINT) AS "grouping", count(*) AS total_rows, count(*) FILTER (status <> 'PENDING') AS processed_rows, count(*) FILTER (status = 'API_ERROR') AS error_count, count(*) FILTER (status = 'MATCH') AS match_count, count(*) FILTER (status = 'REVIEW') AS review_count FROM r GROUP BY CUBE (team, day)""")
def counters_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by team and day, by each, and over all; the team may be null by itself."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "API_ERROR").when(kind == "view", "PENDING").when(kind == "click", "MATCH").otherwise("REVIEW")
    e = S.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4).alias("team"), F.to_date("ts").alias("day"), status.alias("status"), F.when(status == "REVIEW", "REVIEW").alias("decision"), F.lit(None).cast("string").alias("manual_verdict"))
    out = timeline.counters_of_all(e, "team", "day")
    return out.select("team", "day", F.col("grouping").cast("long").alias("grouping"), "total_rows", "processed_rows", "error_count", "match_count", "review_count")


@query("SELECT user_id AS key, count(DISTINCT event_type || (event_id % 3)) >= 12 AS many FROM events GROUP BY user_id")
def owners_by_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that 12 names hold, from sketches of each day; near the threshold counted exactly."""
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name"), F.to_date("ts").alias("day"))
    return timeline.shared_by_many(timeline.sketched(e, "day", "key", "name"), e, "key", "name", 12)
