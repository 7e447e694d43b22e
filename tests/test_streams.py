"""Streams to their end, in several orders of batches and over restarts, against the same from whole tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinlink.streaming import profiles, sessions

SCHEMA = "user string, at timestamp, seq long, identities array<string>"
START = dt.datetime(2024, 1, 1)


def _rows():
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(9)}", START + dt.timedelta(minutes=rng.randrange(40)), k % 17, rng.sample(["a", "b", "c", "d", "e"], rng.randrange(4)) + [None]) for k in range(120)]
    return [*rows, *rows[:5], (None, START, 1, ["a"]), ("u1", None, 1, ["z"]), ("u2", START, None, ["z"]), ("gone", START, 1, ["x"]), ("gone", START + dt.timedelta(days=2), 1, None)]


@pytest.mark.parametrize("order", [0, 1])
def test_last_profile_replaces(spark, tmp_path, order):
    rows = _rows()
    random.Random(order).shuffle(rows)
    source, kept, state = (str(tmp_path / n) for n in ("in", "changes", "state"))
    for k in range(3):  # each run goes on from the state of the one before
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        profiles.keep_changes(profiles.identity_changes(stream, ["user"]), kept, state).awaitTermination()
        so_far = spark.createDataFrame([r for j in range(k + 1) for r in rows[j::3]], SCHEMA)
        found = {r["identity"]: r["accounts"] for r in profiles.owners(spark.read.parquet(kept)).collect()}
        assert found == {r["identity"]: r["accounts"] for r in profiles.last_profiles(so_far, ["user"]).collect()}
        assert "z" not in found


def test_forgotten_profiles(spark, tmp_path):
    source, kept, state = (str(tmp_path / n) for n in ("in", "changes", "state"))
    for day, user in ((0, "old"), (0, "seen"), (9, "seen"), (20, "new"), (20, "new")):
        spark.createDataFrame([(user, START + dt.timedelta(days=day), 1, [user, "all"])], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        profiles.keep_changes(profiles.identity_changes(stream, ["user"], forget=12 * 86400, late="1 hour"), kept, state).awaitTermination()
    assert {r["identity"]: r["accounts"] for r in profiles.owners(spark.read.parquet(kept)).collect()} == {"seen": 1, "new": 1, "all": 2}


def test_late_rows_and_open_sessions(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda m: START + dt.timedelta(minutes=m)
    for batch in ([("a", at(0)), ("a", at(10)), ("b", at(5)), (None, at(5)), ("a", None)], [("a", at(300))], [("a", at(11)), ("c", at(299))]):
        spark.createDataFrame(batch, "key string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, at timestamp").parquet(source)
        sessions.append_available(sessions.sessions(stream, "key", "at"), out, state).awaitTermination()
    # the row of minute 11 came too late; what began at minute 299 and 300 is still open
    found = sorted((r["key"], r["begin"], r["end"], r["n"]) for r in spark.read.parquet(out).collect())
    assert found == [("a", at(0), at(40), 2), ("b", at(5), at(35), 1)]
    whole = sessions.sessions(spark.createDataFrame([("a", at(0)), ("a", at(30)), ("a", at(61))], "key string, at timestamp"), "key", "at")
    assert [r["n"] for r in whole.orderBy("begin").collect()] == [2, 1]
    assert whole.filter(F.col("key").isNull()).count() == 0
