"""Sessions by event time, and requests joined with what followed them, over streams or tables.

On a stream a row that comes later than the watermark is dropped and counted by Spark (``numRowsDroppedByWatermark``); a session is
told once the watermark has passed its end, and an open one stays in the state.  Rows without a key or a time belong to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(rows: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, begin, end, n): runs of a key's rows with no more than ``gap`` between them; end is the last row's time plus the gap."""
    known = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    found = known.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def followed(asked: DataFrame, told: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Rows of ``asked`` (key, asked_at, ...) with each row of ``told`` (key, told_at, ...) at most ``within`` later.

    Both watermarks and the interval bound the state: rows that nothing can meet any more are let go.
    """
    a = asked.withWatermark("asked_at", late).alias("a")
    b = told.withWatermark("told_at", late).alias("b")
    meet = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("told_at") >= F.col("asked_at")) & (F.col("told_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, meet).drop(F.col(f"b.{key}"))


def append_available(stream: DataFrame, output: str, checkpoint: str):
    """Writes what is final of all that has arrived, and stops; a rerun continues after it."""
    return stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
