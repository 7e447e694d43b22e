"""Catalogues of accounts as a Spark data source: a platform is a store of accounts and a row of rules, not code.

``Catalogue(spark, path=folder)`` reads what ``publish`` wrote: ``whole()`` all of it, ``of(handles)`` by a filter that is
pushed to the store.  Then only the buckets that may hold an asked handle are read, and of these only the row groups
whose range of handles holds one.  Another store (an index, a service) is a subclass of ``Store``, named by the option
``store`` as ``module:Class``; the tasks make their own instance.

Spark 4.1 keeps the filters it pushed to a Python source with the loaded table, so a second filter on one DataFrame gets the
first one's rows.  That is why a reader takes only the one filter that it was loaded for, and leaves all others to Spark.
The Python data source has no column pruning: a store gives whole rows.  Null and empty handles are never found; an empty
catalogue gives no rows.
"""

from __future__ import annotations

import importlib
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: A platform's rules, as ``functions.text`` takes them: hosts of its addresses; patterns of handles and of handles made from
#: names; the address before a handle; what a handle has for a name's characters (two texts, as in translate), and for characters
#: that don't tell its accounts apart; first path parts that aren't accounts.
RULES = "platform string, hosts array<string>, valid string, variant string, url string, written array<string>, alike array<string>, reserved array<string>"
KEY = "username"


def bucket_of(handle: str, buckets: int) -> int:
    return zlib.crc32(handle.encode()) % buckets


def publish(profiles: DataFrame, folder: str, buckets: int = 64, parts: int = 1) -> None:
    """Writes a catalogue: a folder for each bucket of handles, in order of handles. The folder must not be there yet.

    parts: files of a bucket, for catalogues whose buckets are too large for one task.
    """
    if "bucket" in profiles.columns:
        raise ValueError("bucket is the catalogue's own column")
    dealt = profiles.filter(F.col(KEY).isNotNull()).withColumn("bucket", F.pmod(F.crc32(F.col(KEY).cast("binary")), F.lit(buckets)).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(KEY), F.lit(parts)))
    dealt.repartition(buckets * parts, "bucket", "part").sortWithinPartitions("bucket", "part", KEY).drop("part").write.partitionBy("bucket").parquet(folder)
    dealt.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{folder}/_buckets")


class Store:
    """Where accounts are. Instances are made from the options on the driver and again in each task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def schema(self) -> StructType:
        raise NotImplementedError

    def splits(self, handles: list[str] | None) -> list[object]:
        """What the tasks read, one each; of these handles only, if there are any given."""
        raise NotImplementedError

    def fetch(self, split: object, handles: list[str] | None) -> Iterator[pa.RecordBatch]:
        """Accounts of a split: those of the handles, or more."""
        raise NotImplementedError


class Buckets(Store):
    """What ``publish`` wrote, on any file system that Arrow reads."""

    def _data(self, path: str | None = None) -> ds.Dataset:
        return ds.dataset(path or self._root, format="parquet", partitioning=None, exclude_invalid_files=False)

    @property
    def _root(self) -> str:
        return self.options["path"].removeprefix("file:")

    def _files(self) -> list[str]:
        return [f for f in self._data().files if f.endswith(".parquet")]

    def schema(self) -> StructType:
        return from_arrow_schema(self._data().schema)

    def splits(self, handles: list[str] | None) -> list[object]:
        files = sorted(self._files())
        if handles is None:
            return files
        note = ds.dataset(f"{self._root}/_buckets", format="json", ignore_prefixes=["."], exclude_invalid_files=True)
        buckets = note.to_table()["buckets"][0].as_py()
        asked = {f"/bucket={bucket_of(h, buckets)}/" for h in handles}
        return [f for f in files if any(a in f for a in asked)]

    def fetch(self, split: object, handles: list[str] | None) -> Iterator[pa.RecordBatch]:
        chosen = None if handles is None else ds.field(KEY).isin(handles)
        yield from self._data(str(split)).to_batches(filter=chosen, batch_size=4096)


@dataclass
class _Split(InputPartition):
    of: object


class _Reader(DataSourceReader):
    def __init__(self, store: str, options: dict[str, str]) -> None:
        self.store, self.options = store, options
        self.handles = json.loads(options["handles"]) if "handles" in options else None

    def _store(self) -> Store:
        return _named(self.store)(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else None
            if asked is None or self.handles is None or f.attribute != (KEY,) or set(asked) != set(self.handles):
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Split(s) for s in self._store().splits(self.handles)] or [_Split(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.of is None:
            return
        for batch in self._store().fetch(partition.of, self.handles):
            if self.handles is not None:
                batch = batch.filter(pa.compute.is_in(batch[KEY], pa.array(self.handles, batch[KEY].type)))
            if batch.num_rows:
                yield batch


def _named(name: str) -> type[Store]:
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)


class Accounts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "accounts"

    def _store(self) -> str:
        return self.options.get("store", f"{__name__}:Buckets")

    def schema(self) -> StructType:
        return _named(self._store())(dict(self.options)).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._store(), dict(self.options))


class Catalogue:
    """A platform's accounts. Options: path of a published folder, or store and whatever that takes."""

    def __init__(self, spark: SparkSession, **options: str) -> None:
        self.spark, self.options = spark, options
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(Accounts)

    def _load(self, **more: str) -> DataFrame:
        return self.spark.read.format("accounts").options(**self.options, **more).load()

    def whole(self) -> DataFrame:
        return self._load()

    def of(self, handles: Iterable[str | None]) -> DataFrame:
        """The accounts of these handles; nothing else is read."""
        asked = sorted({h for h in handles if h is not None})
        return self._load(handles=json.dumps(asked)).filter(F.col(KEY).isin(asked))


def looked_up(keys: DataFrame, accounts: Catalogue, key: str = "handle", pushed: int = 1000) -> DataFrame:
    """Each row of ``keys`` with profile, the account under its handle; null where there is none, for null handles too.

    Up to ``pushed`` different handles are asked for by name; of more than that none is, and the catalogue is joined whole.
    Repeated accounts of one handle give the one with the greatest values.
    """
    asked = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    first = [r[0] for r in asked.limit(pushed + 1).collect()]
    there = accounts.of(first) if len(first) <= pushed else accounts.whole()
    values = F.struct(*[F.sort_array(F.map_entries(f.name)).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in there.schema])
    one = there.groupBy(F.col(KEY).alias(key)).agg(F.max(values).alias("profile"))
    return keys.join(one, key, "left")
