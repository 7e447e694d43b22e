"""Mixing sources to target weights by systematic sampling.

A source's target is its share by weight of all words, at most ``most`` times
its own words, with the excess reshared by weight among the others until no
target is above its bound.  Every document of a source expects target / words
of the source copies.  The expected copies are summed in an order of the
source's documents, one random offset of the source is added, and a document is
emitted once for each integer boundary that its step crosses.  The order is by
size, so the sample is stratified and the words taken come near the target.

Null texts have size 0; null sources form one source, last in order.  Rows are
ordered by (size, md5 of doc_id, doc_id): repeated rows each take their own
place.  A source without words has target 0.  Without rows the mix is empty.
Texts of any length count whole.

The sums are made without a window over a source: rows are dealt by range over
(source, size, hash), numbered within their partition, and the row counts of
(partition, source), a small table, give each partition its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, chunks, free_name, saved, with_row, words

#: Weights repeat over the sources in order.
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Source to target words. sizes: (source, words)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be", "surrogatepass")))
    total = float(sum(n for _, n in order))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    bound = [most * n for _, n in order]
    held = [False] * len(order)
    while True:
        left = total - sum(b for b, h in zip(bound, held, strict=True) if h)
        open_weight = sum(w for w, h in zip(weight, held, strict=True) if not h)
        target = [b if h else left * w / open_weight for w, b, h in zip(weight, bound, held, strict=True)]
        above = [not h and t > b for t, b, h in zip(target, bound, held, strict=True)]
        if not any(above):
            return {s: t for (s, _), t in zip(order, target, strict=True)}
        held = [h or a for h, a in zip(held, above, strict=True)]


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, the text, and size."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for at, to, data, bounds in chunks(batch.columns[-1]):
            size[at:to] = np.bincount(words(data, bounds, False)[1], minlength=to - at)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size)], names=[*batch.schema.names[:-1], "size"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and each row's place among the partition's rows of its source."""
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        place = []
        for source in batch.column(1).to_pylist():
            n = n + 1 if source == last else 1
            last = source
            place.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(place, pa.int64())], names=[*batch.schema.names, "part", "place"])


def _offset(source: Column) -> Column:
    """A source's random offset, 0 to 1."""
    return F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of (doc_id, source, text)."""
    return _mixed(docs.select("doc_id", "source", "text", F.lit(None).cast("int").alias("row")), weights, most).drop("row")


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """mix() with row, of (doc_id, source, text, row)."""
    spark = docs.sparkSession
    base = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, row {docs.schema['row'].dataType.simpleString()}, size long"
    rows = saved(docs.select("doc_id", F.col("source").cast("string"), "row", "text").mapInArrow(_sized, base), "sizes")
    rows = rows.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("hash"), F.col("doc_id"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.mapInArrow(_numbered, f"{base}, hash string, part long, place long").drop("hash")
    placed = saved(placed, "places")
    # one row for each source and partition that holds it
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).drop("n", "words")
    sizes = [(r.source, r.words) for r in counts.groupBy("source").agg(F.sum("words").alias("words")).collect()]
    goal = targets(sizes, weights, most) if sizes else {}
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    goals = spark.createDataFrame([(s, n, goal[s]) for s, n in sizes], schema)
    starts = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["source"].alias("s"), F.col("part").alias("p"), "before", "source_size", "target")
    out = placed.join(starts, (placed["part"] == starts["p"]) & placed["source"].eqNullSafe(starts["s"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("before") + F.col("place")).cast("double")
    copies = F.floor(rank * each + _offset(F.col("source"))) - F.floor((rank - 1) * each + _offset(F.col("source")))
    # a step of at most ``most`` never crosses more whole boundaries than that, but for rounding
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(int(most))).cast("long").alias("copies"))


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, and copy_ (from 1); where docs has such a column, copy_ gets a further underscore."""
    rows = with_row(docs)
    own = rows.select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "source", "text")], "row")
    copies = _mixed(own, weights, most).filter(F.col("copies") > 0).select("row", F.col("copies").cast("int").alias("copies"))
    out = rows.join(copies, "row").select(*by_place(docs).columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.toDF(*docs.columns, free_name("copy_", docs.columns))
