"""Rows that arrive over time: each one is looked up once, results are kept by a checkpoint, and counters follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rows import counters


def first_of_each(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, resolve: Callable[[DataFrame], DataFrame], output: str, checkpoint: str):
    """Resolve all rows that have arrived and stop; a rerun continues after them. A batch that is done again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(results: DataFrame) -> DataFrame:
    """Counters of what has been resolved so far, one row a batch."""
    return counters(results, "batch_id")


def windowed(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by time window and key."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
