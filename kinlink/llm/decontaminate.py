"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Items are cut into windows of ``size`` consecutive words (an item of fewer is
one window).  The tokens of a window are ordered by how often they occur in the
documents, rarest first.  A document holds a window only if it holds all its
tokens, so the necessary prefix is the single rarest one: each document word is
probed in a table of those prefix tokens.  A match says where the window would
have to start; the positional bound (not before the first word) and the length
bound (not past the last) are applied, and then the window's words are compared
with the document's words at that place.

The probe table grows with the benchmark only.  It is broadcast if it has at
most ``broadcast_windows`` windows and ``BROADCAST_BYTES`` bytes; a larger benchmark
is probed in several passes over slices of its windows, each slice within
those bounds.

Null texts have no words.  Each input row gives one row, repeated rows and null
ids too.  Items that repeat a text are all counted.  Without items nothing is hit;
without documents there are no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, saved, with_row

WINDOW = 10
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word holds this; it ends each document's words and carries their number.
END = "\x00"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win: words, items: their ids as strings) of each different window of (item_id, text)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at")
    return w.select("item", "w", starts).select("item", F.slice("w", F.col("at"), size).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))


def _occurrences(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(token, n): how often each token of the benchmark occurs in the documents."""
    tokens = docs.select(F.explode(word_array(F.col("text"))).alias("token"))
    seen = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    return vocabulary.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_table(docs: DataFrame, items: DataFrame, size: int, broadcast_windows: int) -> DataFrame:
    """(token, win, items, before): each window by its rarest token, and how many of its words stand before that."""
    windows = saved(item_windows(items, size), "windows")
    placed = windows.select("win", F.posexplode("win").alias("before", "token"))
    vocabulary = saved(placed.select("token").distinct(), "vocabulary")
    held = vocabulary.agg(F.count("*").alias("n"), F.sum(F.octet_length("token") + 32).alias("bytes")).first()
    small = held.n <= broadcast_windows * size and (held.bytes or 0) <= BROADCAST_BYTES
    rare = _occurrences(docs, vocabulary, small)
    first = placed.join(F.broadcast(rare) if small else rare, "token").groupBy("win").agg(F.min_by(F.struct("token", "before"), F.struct("n", "token", "before")).alias("p"))
    return first.join(windows, "win").select("p.token", "win", "items", "p.before")


def _hits(words: DataFrame, table: DataFrame) -> DataFrame:
    """(row, doc_id, start, length, items) of each window that occurs; a row with null items has the number of words as start."""
    end = table.sparkSession.range(1).select(F.lit(END).alias("token"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).alias("before"))
    probe = F.broadcast(table.select("token", "win", "items", "before").unionByName(end))
    at = words.select("row", "doc_id", "w", F.posexplode("w").alias("pos", "token")).join(probe, "token")
    start, length = F.col("pos") - F.col("before"), F.size("win")
    is_end = F.col("token") == END
    fits = (start >= 0) & (start + length < F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))) == F.col("win")
    return at.filter(is_end | (fits & same)).select("row", "doc_id", start.alias("start"), F.when(is_end, 0).otherwise(length).alias("length"), "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_windows: int = 500_000) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for each (doc_id, text); spans: (start, length) of each occurring window, by start."""
    return _found(with_row(docs.select("doc_id", "text")).toDF("doc_id", "text", "row"), items, size, broadcast_windows).drop("row")


def _found(docs: DataFrame, items: DataFrame, size: int, broadcast_windows: int) -> DataFrame:
    """(row, doc_id, n_words, n_hit, spans, items) for each (doc_id, text, row)."""
    table = saved(prefix_table(docs, items, size, broadcast_windows), "prefixes")
    lengths = lambda words: F.aggregate(words, F.lit(0), lambda n, x: n + F.octet_length(x) + 24)
    held = table.agg(F.count("*").alias("n"), F.sum(lengths("win") + lengths("items")).alias("bytes")).first()
    slices = max(1, -(-held.n // broadcast_windows), -(-(held.bytes or 0) // BROADCAST_BYTES))
    words = docs.select("row", "doc_id", F.array_append(word_array(F.col("text")), END).alias("w"))
    parts = [table] if slices == 1 else [table.filter(F.pmod(F.xxhash64("win"), F.lit(slices)) == k) for k in range(slices)]
    hits = reduce(DataFrame.unionByName, [_hits(words, p) for p in parts])
    is_end = F.col("items").isNull()
    found = hits.groupBy("row", "doc_id").agg(
        F.max(F.when(is_end, F.col("start"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(~is_end, F.struct("start", "length")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    # the words that spans cover, counted from left to right: each span adds what lies past the end so far
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    return found.select("row", "doc_id", "n_words", step.alias("n_hit"), "spans", F.array_sort("items").alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_windows: int = 500_000) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; all columns stay."""
    rows = with_row(docs)
    own = rows.select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "text")], "row")
    bad = _found(own, items, size, broadcast_windows).filter(F.col("n_hit") > 0).select("row")
    return rows.join(bad, "row", "left_anti").select(*by_place(docs).columns).toDF(*docs.columns)
