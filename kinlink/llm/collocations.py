"""Phrase collocation mining by mergeable Misra-Gries summaries, exact in a second pass.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those
into words ``[^\\x20\\x09]+``.  All counts are for each language; a null one is ``und``.

*First pass.*  Each task counts the n-grams of one to ``longest`` words and sends,
for each hash partition, 32-bit keys and counts.  A partition merges these into one
Misra-Gries summary whose capacity exceeds the partition's mass divided by
``least``.  All that merging takes off a counter is then less than ``least``, so
every n-gram with ``least`` occurrences survives; a shared key only lets more survive.

*Second pass.*  A filter of bounded size, filled with the survivors, is broadcast.
Texts are read again; n-grams in it (with all shorter ones inside them) are counted
by their words, in the task and then in their hash partitions.  These counts are exact.  The
filter's false positives, more of them the more survivors there are, add to what is
shuffled and never to what is found.

A phrase's parts occur at least as often as the phrase, so they are among what was
counted.  Scores are whole numbers in decimals of 38 digits.

Null and empty texts hold nothing.  Repeated rows and null ids count each for
themselves.  Ties go by count, then by the phrase's bytes.  Very long texts are read
whole.  Only text and lang are read, whatever other columns there are.  No rows, or none with
``least`` occurrences of a phrase, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE, chunks, discard, mixed, saved, words

LEAST, LONGEST, TOP, NESTED = 10, 3, 2000, 50
#: n-gram occurrences of a hash partition on average; n-grams combined at a time in a task; rows of exact counts held in a task; n-grams written out at a time.
PER_BUCKET, FLUSH, HELD, STEP = 2_000_000, 1 << 21, 1 << 19, 1 << 16
#: Bits of the filter of survivors, and how many of them an n-gram sets.
FILTER_BITS, PROBES = 1 << 28, 3

_Q = np.uint64(0xD6E8FEB86659FD93)
_SPLIT = b".,;:!?\n\x0b\x0c\r"
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[list(_SPLIT + b" \t")] = True
_IS_SPLIT = np.zeros(256, bool)
_IS_SPLIT[list(_SPLIT)] = True


class Grams:
    """The n-grams of a chunk of texts: words in order, and for each size the first words of n-grams with their hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, salt: np.ndarray, longest: int) -> None:
        self.data = data
        value, self.row, self.start, self.end = words(data, bounds, False, _OUTSIDE)
        splits = np.concatenate([[0], np.cumsum(_IS_SPLIT[data])])
        # whether the word after stands in the same piece
        joined = (self.row[1:] == self.row[:-1]) & (splits[self.start[1:]] == splits[self.end[:-1]]) if len(value) else np.zeros(0, bool)
        self.first, self.key = [np.arange(len(value))], [mixed(value ^ salt[self.row])]
        run, alive = self.key[0], np.ones(len(value), bool)
        for k in range(1, longest):
            alive = alive[:-1] & joined[k - 1 :] if len(alive) else alive
            run = mixed(run[:-1] * _Q + value[k:] + np.uint64(k)) if len(run) else run
            self.first.append(np.flatnonzero(alive))
            self.key.append(run[alive])

    def texts(self, size: int, first: np.ndarray) -> pa.Array:
        """The n-grams of ``size`` words that begin at words ``first``, lower-cased, with one space between words."""
        at = first[:, None] + np.arange(size)[None, :]
        # each word with the byte before it, which becomes the space
        length = (self.end - self.start)[at] + 1
        lengths = length.reshape(-1)
        to = np.cumsum(lengths)
        source = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.start[at].reshape(-1) - 1 - (to - lengths), lengths)
        out = self.data[np.maximum(source, 0)]
        upper = (out >= 65) & (out <= 90)
        out = np.where(upper, out + np.uint8(32), out)
        out[(to - lengths)] = 32
        keep = np.ones(len(out), bool)
        keep[(to - lengths)[::size]] = False  # no space before the first word
        ends = np.concatenate([[0], np.cumsum(length.sum(1) - 1)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out[keep]))])


def _salts(lang: pa.Array) -> np.ndarray:
    """A number for each row's language."""
    codes = lang.dictionary_encode()
    hashes = np.array([int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") ^ hash_text(x) for x in codes.dictionary.to_pylist()], np.uint64)
    return hashes[codes.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.uint64)


def hash_text(x: str) -> int:
    """A stable 64-bit hash of a short text."""
    out = 1469598103934665603
    for b in x.encode():
        out = (out ^ b) * 1099511628211 % 2**64
    return out


def bucket_and_key(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash partition of n-grams, and their 32-bit keys within it."""
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), key.astype(np.uint32)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their sums of n."""
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(n, start) if len(start) else n


def _counts(buckets: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, keys, ones, n): keys with one occurrence come last and without a count."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        bucket, short = bucket_and_key(key, buckets)
        by = np.lexsort((n == 1, bucket))
        bucket, short, n = bucket[by], short[by], n[by].astype(np.uint32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        ks = np.flatnonzero(np.diff(cut))
        rows = [(short[cut[k] : cut[k + 1]].tobytes(), n[cut[k] : cut[k + 1]]) for k in ks]
        return pa.RecordBatch.from_arrays([pa.array(ks.astype(np.int32)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1][r[1] > 1].tobytes() for r in rows], pa.binary())], names=["bucket", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            salt = _salts(batch.column(1))
            for at, to, data, bounds in chunks(batch.column(0), LARGE):
                keys = Grams(data, bounds, salt[at:to], longest).key
                held += keys
                size += sum(map(len, keys))
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, each too low by at most ``taken``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.key, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        """Merges another summary: the counters are added, and the largest beyond the capacity is taken off all."""
        self.key, self.n = _summed(np.concatenate([self.key, key]), np.concatenate([self.n, n]))
        if len(self.n) > self.capacity:
            off = int(np.partition(self.n, len(self.n) - self.capacity - 1)[len(self.n) - self.capacity - 1])
            keep = self.n > off
            self.key, self.n, self.taken = self.key[keep], self.n[keep] - off, self.taken + off

    def over(self, least: int) -> np.ndarray:
        """Keys that may have ``least`` occurrences; none that has is missing."""
        return self.key[self.n + self.taken >= least]


def _survivors(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for keys, n in zip(group["keys"], group["n"], strict=True):
            key, several = np.frombuffer(keys, np.uint32), np.frombuffer(n, np.uint32)
            parts.append((key, np.concatenate([several.astype(np.int64), np.ones(len(key) - len(several), np.int64)])))
        summary = Summary(sum(int(n.sum()) for _, n in parts) // least + 1)
        step = max(1, len(parts) // 8)
        for at in range(0, len(parts), step):
            summary.add(*(np.concatenate(x) for x in zip(*parts[at : at + step], strict=True)))
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "n": [len(summary.over(least))], "keys": [summary.over(least).tobytes()]})

    return run


def _places(bucket: np.ndarray, key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of the filter that n-grams set."""
    h = mixed(key.astype(np.uint64) + bucket.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64) for k in range(PROBES)]


def _filter(survivors: DataFrame, bits: int) -> np.ndarray:
    """The filter, gathered as its words that aren't empty: no more bytes than it has, whatever the number of survivors."""

    part_bits = 1 << 23

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                key = np.frombuffer(keys.as_buffer(), np.uint32)
                place = np.unique(np.concatenate(_places(np.full(len(key), bucket), key, bits)))
                cut = np.searchsorted(place, np.arange(0, bits + part_bits, part_bits))
                ats = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(ats * part_bits, pa.int64()), pa.array([(place[cut[k] : cut[k + 1]] - k * part_bits).astype(np.uint32).tobytes() for k in ats], pa.binary())], names=["at", "places"])

    def either(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(part_bits, np.uint8)
        for places in group["places"]:
            out[np.frombuffer(places, np.uint32)] = 1
        return pd.DataFrame({"at": group["at"].iloc[:1], "part": [np.packbits(out).tobytes()]})

    out = np.zeros(max(bits, part_bits) // 8, np.uint8)
    for row in survivors.mapInArrow(run, "at long, places binary").groupBy("at").applyInPandas(either, "at long, part binary").toLocalIterator():
        part = np.frombuffer(row["part"], np.uint8)
        out[row["at"] // 8 : row["at"] // 8 + len(part)] = part
    return out


_COUNTED = ["bucket", "lang", "size", "phrase"]
_PACKED = "bucket int, part binary"


def _told(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(keys).aggregate([("f", "sum")]).rename_columns([*keys, "f"])


def _squeezed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _exact(found, buckets: int, bits: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each hash partition: lang, size, phrase and f of the n-grams in the filter, counted in the task; of size 0 and without a phrase, all words."""

    def kept(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.arange(len(key))
        for place in _places(bucket, key, bits):
            place = place[out]
            out = out[(found.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
        return out

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("bucket").combine_chunks()
        own, start = np.unique(table.column("bucket").to_numpy(), return_index=True)
        table, ends = table.drop_columns("bucket"), np.append(start, len(table))
        parts = [_squeezed(table.slice(a, b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(parts, pa.binary())], names=["bucket", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.large_string()), ("f", pa.int64())])
        whole_numbers = lambda x: pa.array(np.asarray(x, np.int32))
        for batch in batches:
            salt, langs = _salts(batch.column(1)), batch.column(1)
            for at, to, data, bounds in chunks(batch.column(0), LARGE):
                grams, lang = Grams(data, bounds, salt[at:to], longest), langs.slice(at, to - at)
                rows, n = np.unique(grams.row, return_counts=True)
                home, _ = bucket_and_key(salt[at:to][rows], buckets)
                parts = [pa.Table.from_arrays([whole_numbers(home), lang.take(pa.array(rows)), whole_numbers(np.zeros(len(rows))), pa.nulls(len(rows), pa.large_string()), pa.array(n.astype(np.int64))], schema=schema)]
                whole = np.ones(len(grams.row), bool)
                for size, (first, key) in enumerate(zip(grams.first, grams.key, strict=True), 1):
                    # an n-gram stands only where both of its shorter ones do
                    open_ = whole[first] & whole[first + 1] if size > 1 else whole
                    first, (bucket, short) = first[open_], bucket_and_key(key[open_], buckets)
                    there = kept(bucket, short)
                    first, bucket = first[there], bucket[there]
                    whole = np.zeros(len(grams.row), bool)
                    whole[first] = True
                    for a in range(0, len(first), STEP):
                        own = first[a : a + STEP]
                        parts.append(_told([pa.Table.from_arrays([whole_numbers(bucket[a : a + STEP]), lang.take(pa.array(grams.row[own])), whole_numbers(np.full(len(own), size)), grams.texts(size, own), pa.array(np.ones(len(own), np.int64))], schema=schema)], _COUNTED))
                held.append(_told(parts, _COUNTED))
                if sum(map(len, held)) > HELD:
                    held = [_told(held, _COUNTED)]
                    if len(held[0]) > HELD // 2:
                        yield packed(held[0])
                        held = []
        if held:
            yield packed(_told(held, _COUNTED))

    return run


def _often(least: int) -> Callable[[pa.Table], pa.Table]:
    """A hash partition's n-grams with ``least`` occurrences, and all words of the languages that are counted there."""

    def run(group: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(part.as_buffer()).read_all() for part in group.column("part")]
        out = _told(parts, ["lang", "size", "phrase"])
        out = out.filter(pc.or_(pc.greater_equal(out.column("f"), least), pc.equal(out.column("size"), 0)))
        return out.set_column(2, "phrase", pc.cast(out.column("phrase"), pa.string()))

    return run


def grams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, per_bucket: int = PER_BUCKET, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, size, phrase, f): the n-grams of up to ``longest`` words with ``least`` occurrences; of size 0 and with a null phrase, all words of a language."""
    spark = docs.sparkSession
    rows = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(24, size * longest // (6 * per_bucket)))
    counted = rows.mapInArrow(_counts(buckets, longest), "bucket int, keys binary, n binary")
    survivors = saved(counted.groupBy("bucket").applyInPandas(_survivors(least), "bucket int, n long, keys binary"), "survivors")
    total = survivors.agg(F.sum("n")).first()[0] or 0
    bits = min(filter_bits, 1 << max(23, int(16 * total).bit_length()))
    found = spark.sparkContext.broadcast(_filter(survivors, bits))
    exact = rows.mapInArrow(_exact(found, buckets, bits, longest), _PACKED).groupBy("bucket").applyInArrow(_often(least), "lang string, size int, phrase string, f long")
    out = saved(exact, "grams")
    discard(survivors)
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits; it is at most 1000000."""
    wide = lambda x: x.cast("decimal(15,0)")
    above, below = F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right)
    return F.call_function("div", above, below)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, nested: int = NESTED, per_bucket: int = PER_BUCKET, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases of two to ``longest`` words, best first.

    A phrase goes if its words stand inside a longer one that has at least ``nested`` percent of its occurrences.
    """
    found = grams(docs, least, longest, per_bucket, filter_bits)
    phrases = found.filter("size > 1").withColumn("w", F.split("phrase", " "))
    parts = found.filter(F.col("size").between(1, longest - 1)).select("lang", "phrase", "f")

    # all shorter phrases that stand inside a phrase
    inside = [F.when(F.col("size") >= max(k + 1, i + k), F.array_join(F.slice("w", i + 1, k), " ")) for k in range(2, longest) for i in range(longest - k + 1)]
    longer = phrases.select("lang", F.explode(F.array_distinct(F.array_compact(F.array(*inside, F.lit(None).cast("string"))))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < nested * F.col("f"))).drop("longer")

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    scored = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = found.filter("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
