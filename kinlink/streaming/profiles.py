"""Profiles that arrive over time: the last one of an account replaces the one before, and the counts of identities follow by retraction.

An account's state is its last profile's order and identities.  A newer profile adds one to each identity that it has and the old one
has not, and takes one from each that only the old one has; an older one changes nothing.  So the sums of the changes are those of the
last profiles alone, in whatever order and batches the rows came.  Of two profiles at one time the one with the greater ``seq`` counts, and
of two equal ones the one whose identities come last.  Rows without an account, a time or a ``seq`` are left out; null identities too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGE = "identity string, change int"


class LastProfile(StatefulProcessor):
    """Changes of identities by account. With ``forget``, an account not seen for so many seconds of event time loses its profile."""

    def __init__(self, forget: int | None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        newest = before
        for part in rows:
            for at, seq, held in zip(part["at"], part["seq"], part["held"], strict=True):
                row = int(at), int(seq), held
                if newest is None or row > newest:
                    newest = row
        if newest == before:
            return
        self.last.update(newest)
        if self.forget is not None:
            if before is not None:
                self.handle.deleteTimer(self._due(before[0]))
            self.handle.registerTimer(self._due(newest[0]))
        yield self._changes(json.loads(before[2]) if before else [], json.loads(newest[2]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            held = json.loads(tuple(self.last.get())[2])
            self.last.clear()
            yield self._changes(held, [])

    def close(self) -> None:
        pass

    def _due(self, at: int) -> int:
        return at // 1000 + self.forget * 1000

    @staticmethod
    def _changes(old: list[str], new: list[str]) -> pd.DataFrame:
        rows = [(i, -1) for i in sorted(set(old) - set(new))] + [(i, 1) for i in sorted(set(new) - set(old))]
        return pd.DataFrame(rows, columns=["identity", "change"]).astype({"change": "int32"})


def identity_changes(profiles: DataFrame, account: list[str], forget: int | None = None, late: str = "1 day") -> DataFrame:
    """(identity, change) for a stream of (account, at timestamp, seq long, identities array<string>).

    With ``forget``, rows later than the watermark are dropped by Spark, and an account whose last profile is older than the watermark by
    ``forget`` seconds is let go.
    """
    profiles.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = profiles.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*account, "at", "seq"]))
    if forget is not None:
        known = known.withWatermark("at", late)
    held = F.to_json(F.array_sort(F.array_distinct(F.filter(F.coalesce("identities", F.array().cast("array<string>")), lambda i: i.isNotNull()))))
    stamp = [F.col("at").alias("stamp")] if forget is not None else []  # keeps the column that the watermark belongs to
    rows = known.select(*account, F.unix_micros("at").alias("at"), F.col("seq").cast("long").alias("seq"), held.alias("held"), *stamp)
    return rows.groupBy(*account).transformWithStateInPandas(LastProfile(forget), _CHANGE, "Update", "None" if forget is None else "EventTime")


def keep_changes(changes: DataFrame, output: str, checkpoint: str):
    """Adds up each batch's changes and writes them; a batch that is done again replaces its own files. Ends when all that has arrived is done."""

    def write(batch: DataFrame, batch_id: int) -> None:
        summed = batch.groupBy("identity").agg(F.sum("change").alias("change")).filter("change <> 0")
        summed.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def owners(kept: DataFrame) -> DataFrame:
    """(identity, accounts) by the changes so far; identities that nobody holds any more are left out."""
    return kept.groupBy("identity").agg(F.sum("change").alias("accounts")).filter("accounts <> 0")


def last_profiles(profiles: DataFrame, account: list[str]) -> DataFrame:
    """The same counts from all profiles at once, to compare with."""
    known = profiles.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*account, "at", "seq"]))
    held = F.array_sort(F.array_distinct(F.filter(F.coalesce("identities", F.array().cast("array<string>")), lambda i: i.isNotNull())))
    last = known.withColumn("held", held).groupBy(*account).agg(F.max_by("held", F.struct("at", "seq", F.to_json("held"))).alias("held"))
    return last.select(F.explode("held").alias("identity")).groupBy("identity").agg(F.count("*").alias("accounts"))
