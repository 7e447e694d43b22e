"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z
lower-cased, hashed to 128 bits.  :class:`LineRuns` keeps how many documents
hold each key in sorted runs in the shared folder.  A new batch merge-anti-joins
the keys that the runs already know as frequent, and what is left is added as a
run of level 0; ``fanout`` runs of one level are compacted to one of the next.
After all batches, keys in at least ``min_docs`` documents lose all their lines.

The frequent keys are broadcast if there are at most ``broadcast_keys`` (16
bytes each), else they are joined to the documents' lines by a shuffle; both
give the same result.

Null and empty texts are one empty line; an empty key is never dropped.  Each
input row is a document of its own, repeated rows and null ids too.  A document
that loses all lines keeps its row with an empty text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, saved, shared_dir, with_row

WHITE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_keys(text: str | None) -> tuple[list[str], np.ndarray]:
    """The lines of a text, and the 16 bytes of each line's key; zeros where the key is empty."""
    lines = (text or "").split("\n")
    out = bytearray()
    for line in lines:
        key = line.strip(WHITE).encode("utf-8", "surrogatepass").lower()
        out += hashlib.blake2b(key, digest_size=16).digest() if key else b"\0" * 16
    return lines, np.frombuffer(bytes(out), "<i8").reshape(-1, 2)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, h1, h2) for each distinct non-empty key of each document."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            keys, parts = [], []
            for part, text in zip(batch.column(0).slice(at, 512).to_pylist(), batch.column(1).slice(at, 512), strict=True):
                own = np.unique(line_keys(text.as_py())[1], axis=0)
                own = own[own.any(axis=1)]
                keys.append(own)
                parts.append(np.full(len(own), part, np.int32))
            found = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["part", *KEY])


class LineRuns:
    """How many documents hold each line key, as levels of sorted runs in a shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, root: str | None = None) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, counts: DataFrame) -> str:
        path = f"{self.root}/{self.written}"
        self.written += 1
        counts.repartitionByRange("h1").sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)

    def _put(self, path: str, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._read(self.levels[level]).groupBy(*KEY).agg(F.sum("n").alias("n"))
            self.levels[level] = []
            self._put(self._write(merged), level + 1)

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (h1, h2, n); its documents must be in no other batch."""
        paths = [p for level in self.levels for p in level]
        if paths:
            known = self._read(paths).filter(F.col("n") >= self.min_docs).select(*KEY).distinct()
            counts = counts.join(known.hint("merge"), KEY, "left_anti")
        self._put(self._write(counts), 0)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys in at least min_docs documents."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._read(paths).groupBy(*KEY).agg(F.sum("n").alias("n")).filter(F.col("n") >= self.min_docs).select(*KEY)


def frequent_lines(docs: DataFrame, min_docs: int, batches: int = 4) -> DataFrame:
    """(h1, h2) of the line keys in at least ``min_docs`` rows of ``docs``, by runs built from ``batches`` batches."""
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).cast("int")
    lines = docs.select(part.alias("part"), "text").mapInArrow(_hashed, "part int, h1 long, h2 long")
    counts = lines.groupBy("part", *KEY).agg(F.count("*").alias("n"))
    counts = saved(counts, "line-hashes")
    runs = LineRuns(docs.sparkSession, min_docs)
    for k in range(batches):
        runs.add(counts.filter(F.col("part") == k).select(*KEY, "n"))
    return runs.frequent()


def _as_void(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view([("h1", "<i8"), ("h2", "<i8")]).reshape(-1)


def _kept(text: str | None, frequent: np.ndarray) -> tuple[str, int, int]:
    """Text without the frequent lines, lines before, lines dropped; frequent: sorted (h1, h2) records."""
    lines, keys = line_keys(text)
    drop = keys.any(axis=1) & np.isin(keys[:, 0], frequent["h1"])
    for i in np.flatnonzero(drop):
        a, b = np.searchsorted(frequent["h1"], keys[i, 0], "left"), np.searchsorted(frequent["h1"], keys[i, 0], "right")
        drop[i] = keys[i, 1] in frequent["h2"][a:b]
    return "\n".join(x for x, gone in zip(lines, drop, strict=True) if not gone), len(lines), int(drop.sum())


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, broadcast_keys: int = 2_000_000) -> DataFrame:
    """``docs`` with the text's repeated lines dropped, plus n_lines_ and n_dropped_ (long) as last columns; all other columns stay, also of such names."""
    spark = docs.sparkSession
    frequent = saved(frequent_lines(docs, min_docs, batches), "frequent-lines")
    at = docs.columns.index("text")
    plain = by_place(docs)
    names = plain.columns
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    if frequent.count() <= broadcast_keys:
        rows = frequent.toPandas()
        keys = np.sort(_as_void(rows[KEY].to_numpy(np.int64)), order=KEY)
        table = spark.sparkContext.broadcast(keys)
        cut = plain.withColumn("keys", F.lit(None).cast("binary"))
    else:
        table = None
        numbered = with_row(docs)
        held = numbered.select("row", f"c{at}").mapInArrow(_with_row, "row struct<file string, index long>, h1 long, h2 long")
        found = held.join(frequent, KEY).groupBy("row").agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("keys"))
        found = found.select("row", F.to_json("keys").cast("binary").alias("keys"))
        cut = numbered.join(found, "row", "left").select(*names, "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        none = _as_void(np.zeros((0, 2), np.int64))
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            frequent = table.value if table is not None else none
            texts, lines, dropped = [], [], []
            for text, own in zip(batch.column(at), batch.column(len(names)), strict=True):
                if own.is_valid:
                    frequent = _as_void(np.array([[x["h1"], x["h2"]] for x in json.loads(own.as_py())], np.int64))
                elif table is None:
                    frequent = none
                kept, n, k = _kept(text.as_py(), frequent)
                texts.append(kept)
                lines.append(n)
                dropped.append(k)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "a", "b"])

    out = cut.mapInArrow(run, T.StructType([*fields, T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    return out.toDF(*docs.columns, "n_lines_", "n_dropped_")


def _with_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, h1, h2) for each distinct non-empty key of each document."""
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            own = np.unique(line_keys(text.as_py())[1], axis=0)
            own = own[own.any(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(own), i))), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["row", *KEY])
