"""How much the word sets of all texts of a group overlap: every pair, in blocks that fit a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shares(words: pd.Series, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard of each set of ``left`` with each of ``right``; words: sets as text, by place."""
    lists = [w.split(" ") if w else [] for w in words]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    codes, known = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    ends = np.cumsum(sizes)
    chosen = np.concatenate([codes[ends[y] - sizes[y] : ends[y]] for y in right]) if len(right) else codes[:0]
    until = np.cumsum(sizes[right])
    out, held = np.zeros((len(left), len(right))), np.zeros(len(known), dtype=np.int64)
    for place, x in enumerate(left):
        own = codes[ends[x] - sizes[x] : ends[x]]
        held[own] = 1
        total = np.concatenate([[0], np.cumsum(held[chosen])])
        held[own] = 0
        both = total[until] - total[until - sizes[right]]
        union = sizes[x] + sizes[right] - both
        out[place] = np.divide(both, union, out=np.zeros(len(right)), where=union > 0)
    return out


def _block_pairs(block: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one pair of blocks: within one, or between the two. Equal sets are compared once."""
    sets, words = pd.factorize(block["words"])
    ids, first = block["doc_id"].to_numpy(), (block["block"] == block["low"]).to_numpy()
    a = np.flatnonzero(first)
    b = a if block["low"].iat[0] == block["high"].iat[0] else np.flatnonzero(~first)
    left, x = np.unique(sets[a], return_inverse=True)
    right, y = np.unique(sets[b], return_inverse=True)
    shares = _shares(pd.Series(words), left, right)
    i, j = np.nonzero(ids[a][:, None] < ids[b][None, :] if b is a else ids[a][:, None] != ids[b][None, :])
    p, q = ids[a][i], ids[b][j]
    return pd.DataFrame({"a_id": np.minimum(p, q), "b_id": np.maximum(p, q), "jaccard": shares[x[i], y[j]]})


def jaccard_pairs(docs: DataFrame, by: list[str], length: str, most: int = 500, most_characters: int = 4_000_000) -> DataFrame:
    """(a_id, b_id, jaccard) of all pairs of texts that agree in ``by``, a_id < b_id. docs: (doc_id, text, ...); a text without words shares nothing.

    There are as many rows as pairs, which grow with the square of a group.  A task holds two blocks at a time, of about ``most``
    texts or ``most_characters`` by their ``length`` (one of ``by``); each text goes to as many tasks as its group has blocks.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    blocks = F.ceil(F.greatest(F.col("n") / most, F.col("n") * F.col(length) / most_characters)).cast("int")
    counts = known.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by, F.greatest(F.lit(1), blocks).alias("blocks"))
    words = F.array_join(F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), ""))), " ")
    placed = known.join(counts, by).select("doc_id", *by, "blocks", F.coalesce(words, F.lit("")).alias("words"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    return keyed.groupBy(*by, "low", "high").applyInPandas(_block_pairs, "a_id long, b_id long, jaccard double")
