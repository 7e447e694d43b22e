"""Accounts of any number of platforms, each known by a row of rules and a catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.accounts import Catalogue, looked_up


def with_handles(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells (platform, value, ...) with handle and rules: null where the platform has no rules or the value can't be its handle.

    rules: a row for each platform, as ``sources.accounts.RULES``.
    """
    known = rules.select("platform", F.struct(*rules.columns).alias("rules"))
    return cells.join(known, "platform", "left").withColumn("handle", X.normalize_handle(F.col("value"), F.col("rules")))


def found(cells: DataFrame, rules: DataFrame, accounts: dict[str, Catalogue], pushed: int = 1000) -> DataFrame:
    """Cells with handle, and profile: the account that exists under the handle or, if none does, under one that means the same.

    accounts: the catalogues by platform, of one schema.  Each handle is asked for once, however many cells hold it.  Rows
    without a handle, or of a platform without a catalogue, have no profile; repeated cells stay repeated.
    """
    keyed = with_handles(cells, rules)
    asked = keyed.filter(F.col("handle").isNotNull()).select("platform", "handle", X.existence_variants(F.col("handle"), F.col("rules")).alias("names")).distinct()
    asked = asked.select("platform", "handle", F.posexplode("names").alias("ord", "asked"))
    each = [looked_up(asked.filter(F.col("platform") == name), there, "asked", pushed).filter("profile IS NOT NULL") for name, there in sorted(accounts.items())]
    first = reduce(DataFrame.unionByName, each).groupBy("platform", "handle").agg(F.min_by("profile", "ord").alias("profile"))
    return keyed.drop("rules").join(first, ["platform", "handle"], "left")
