"""What the operators share: saved intermediate tables and vectorised word hashes.

Word hashes are computed for a whole Arrow batch at a time from the UTF-8
bytes, so no Python object is made for a word.  Rows are taken in chunks of
about ``CHUNK`` bytes, which bounds the memory of a task by the longest text.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at a time: usually, and where a chunk's results are packed for a shuffle.
CHUNK, LARGE = 1 << 18, 1 << 20
#: The white space of the contracts: space and \t \n \v \f \r.
WHITE = b" \t\n\x0b\x0c\r"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[:128] = True
_IS_PUNCT[48:58] = False  # 0-9
_IS_PUNCT[97:123] = False  # a-z; A-Z are lower-cased before
_BYTE = np.random.default_rng(20240117).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FOLDERS: dict[str, str] = {}
_PATHS: dict[int, tuple[weakref.ref, str]] = {}
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all tasks run in the driver's process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _FOLDERS:
        _FOLDERS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="kinlink-")
    return _FOLDERS[spark.sparkContext.applicationId]


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out, lambda _, key=id(out): _PATHS.pop(key, None)), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`saved` wrote, once all that reads them is saved itself; the shuffles behind them may go too."""
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()  # Spark drops the files of shuffles that nothing refers to
    for df in tables:
        _, path = _PATHS.pop(id(df))
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(hadoop).delete(there, True)


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no name that is added can clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with further underscores while a column has it; Spark doesn't tell capitals from small letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bare_scan(df: DataFrame) -> bool:
    """Whether ``df`` is rows of files, at most projected and filtered: then no row of a file occurs twice, and all reads see the same rows."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty() and len(set(df.inputFiles())) > 0


def with_row(df: DataFrame) -> DataFrame:
    """``df`` by place, and row: struct(file, index), which no two rows share. Rows that aren't read straight from Parquet files are saved first."""
    where = lambda d: by_place(d).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")).alias("row"))
    if _bare_scan(df):
        try:
            return where(df)
        except AnalysisException:  # files that aren't Parquet
            pass
    return where(saved(by_place(df), "rows"))


def held_out(modulus: int, column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus`` is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == 2, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(max(n, LARGE + 1), base, np.uint64)
            out[0] = 1
            _POW[k] = np.multiply.accumulate(out)
    return _POW[0], _POW[1]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows on end and the n + 1 row bounds; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = column.buffers()
    bounds = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of runs of whole rows of about ``size`` bytes."""
    if len(column) == 0:
        return
    data, bounds = text_buffers(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray, punctuation: bool, outside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte, end byte) of each word of rows of bytes, with A-Z lower-cased.

    punctuation: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, else ``[^\\x20\\x09-\\x0D]+``; or
    outside: which of the 256 bytes stand between words.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    low = _LOWER[data]
    inside = ~(outside if outside is not None else _IS_PUNCT if punctuation else _IS_WHITE)[low]
    row_start = np.zeros(n + 1, bool)
    row_start[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | row_start[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | row_start[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[:n], out=total[1:])
    value = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return value, np.searchsorted(bounds, start, "right") - 1, start, end


def hash_words(texts: list[str], punctuation: bool) -> list[np.ndarray]:
    """The word hashes of each of a few texts."""
    data, bounds = text_buffers(pa.array(texts, pa.string()))
    value, row, _, _ = words(data, bounds, punctuation)
    return [value[row == k] for k in range(len(texts))]


def in_sorted(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of ``keys`` in ``sorted_keys``."""
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[place] == keys, place


