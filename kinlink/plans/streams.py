"""Queries that run streams over ``events`` to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import saved
from ..streaming import profiles, sessions
from . import standins as S
from .catalogue import query

#: Micro-batches that the queries take.
BATCHES = 3


def _folder(table: DataFrame) -> str:
    return table.inputFiles()[0].rsplit("/", 1)[0]


def _streamed(spark: SparkSession, table: DataFrame) -> tuple[DataFrame, str]:
    """A saved table as a stream of a few batches, and a new folder beside it."""
    files = len(table.inputFiles())
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(_folder(table))
    return stream, f"{_folder(table)}-{uuid.uuid4().hex}"


@query("""WITH last AS (SELECT user_id, arg_max(event_type || ',v' || CAST(floor(value) AS BIGINT) % 40, (ts, event_id)) AS held FROM events GROUP BY user_id)
SELECT identity, count(*) AS accounts FROM (SELECT unnest(string_split(held, ',')) AS identity FROM last) GROUP BY identity""")
def profiles_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many accounts hold an identity, with each event as a new profile of its user; batches come in no order of time."""
    e = S.table(spark, sf_dir, "events")
    held = F.array("event_type", F.concat(F.lit("v"), (F.floor("value") % 40).cast("string")))
    told = saved(e.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), held.alias("identities")).repartition(2 * BATCHES, F.crc32(F.col("event_id").cast("string"))), "profiles")
    stream, folder = _streamed(spark, told)
    profiles.keep_changes(profiles.identity_changes(stream, ["user_id"]), f"{folder}/changes", f"{folder}/state").awaitTermination()
    return profiles.owners(spark.read.schema("identity string, change long").parquet(f"{folder}/changes"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, from a stream by day; a row of no user far ahead closes the last ones."""
    e = S.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = e.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    rows = saved(e.unionByName(end), "events")
    stream = spark.readStream.schema(rows.schema).parquet(_folder(rows))
    folder = f"{_folder(rows)}-{uuid.uuid4().hex}"
    sessions.append_available(sessions.sessions(stream, "user_id", "ts", "6 hours"), f"{folder}/sessions", f"{folder}/state").awaitTermination()
    done = spark.read.schema("user_id long, begin timestamp, end timestamp, n long").parquet(f"{folder}/sessions")
    return done.filter("user_id >= 0").select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""SELECT a.event_id AS asked, b.event_id AS told, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR
WHERE a.event_type = 'error' AND b.event_type = 'click'""")
def clicks_after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with its user's clicks in the two hours after it, as a join of two streams."""
    e = saved(S.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), "events")
    read = lambda kind, at, name: spark.readStream.schema(e.schema).parquet(_folder(e)).filter(F.col("event_type") == kind).select("user_id", F.col("ts").alias(at), F.col("event_id").alias(name))
    folder = f"{_folder(e)}-{uuid.uuid4().hex}"
    both = sessions.followed(read("error", "asked_at", "asked"), read("click", "told_at", "told"), "user_id", "2 HOURS").select("asked", "told", "user_id")
    sessions.append_available(both, f"{folder}/pairs", f"{folder}/state").awaitTermination()
    return spark.read.schema("asked long, told long, user_id long").parquet(f"{folder}/pairs")
