"""Token counts by a map-side two-tier lookup.

A pre-token is a run of spaces with the text up to the next space or line
feed.  No piece of a SentencePiece BPE vocabulary of this kind holds a space
after another character, or a line feed, so no merge crosses a pre-token's
bounds and the count of a text is the sum over its pre-tokens
(:func:`check_splittable` verifies this for the given model).

Tier 1 is a broadcast table of the lengths of the most frequent pre-tokens,
at most ``table_size`` entries; each task names its ``per_task`` most frequent
ones, over all texts.  Tier 2 is a bounded cache in each Python worker, whose misses
are encoded.  Pre-tokens are never shuffled, and the counts are exact whatever
the tables hold.

Null and empty texts have 0 tokens; each input row gives one row, repeated
rows and null ids too; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
OVER = 4096
_CACHES: dict[str, "Lengths"] = {}


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_splittable(model) -> None:
    """Raise ValueError where a piece of the model crosses the bounds of pre-tokens."""
    for i in range(model.get_piece_size()):
        if re.search(f"[^{MARK}]{MARK}|\n", model.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses pre-tokens")


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


class Lengths(dict):
    """Tier 2: pre-token to its number of tokens, at most ``room`` entries; a miss is encoded."""

    def __init__(self, path: str, room: int) -> None:
        super().__init__()
        self.model, self.room = load(path), room

    def __missing__(self, key: str) -> int:
        # after a line feed no dummy space is added; the text before the key takes two tokens
        n = 1 if key == "\n" else len(self.model.encode("\n" + key.replace(MARK, " "), num_threads=1)) - 2
        if len(self) >= self.room:
            self.clear()
        self[key] = n
        return n


def _cache(path: str, room: int) -> Lengths:
    if path not in _CACHES:
        _CACHES[path] = Lengths(path, room)
    return _CACHES[path]


def _frequent(per_task: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py()))
                if len(seen) > 50 * per_task:
                    seen = Counter(dict(seen.most_common(25 * per_task)))
        top = [(k, n) for k, n in seen.most_common(per_task) if n > 1]
        yield pa.RecordBatch.from_pydict({"pre_token": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    return run


def frequent_lengths(docs: DataFrame, path: str, table_size: int = 8192, per_task: int = 1024) -> dict[str, int]:
    """Tier 1: the lengths of at most ``table_size`` frequent pre-tokens of all texts."""
    named = docs.select("text").mapInArrow(_frequent(per_task), "pre_token string, n long")
    top = named.groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(table_size).collect()
    lengths = Lengths(path, table_size + 1)
    return {r.pre_token: lengths[r.pre_token] for r in top}


def count_tokens(docs: DataFrame, path: str, table_size: int = 8192, per_task: int = 1024, cache_size: int = 300_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of (doc_id, text).

    path: of the model, where every executor can read it.  cache_size: entries of a
    worker's cache, about 150 bytes each.
    """
    check_splittable(load(path))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, table_size, per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, cache = table.value, _cache(path, cache_size)
        for batch in batches:
            counts = []
            for text in batch.column(1):
                n = 0
                for key in pre_tokens(text.as_py()):
                    n += first.get(key) or cache[key]
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)
