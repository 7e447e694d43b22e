"""What held when: as-of joins, overlapping intervals, counters over all groupings, and owners counted by increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from .rows import counters

#: Levels of the grid of intervals: each is twice as coarse as the one before.
LEVELS = 40


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same ``by`` and no later ``at``; null where there is none.

    Of several rows at one time the one with the greatest values counts.  Null times and keys meet nothing.  Both sides are
    dealt by range over (by, at), so a hot key is spread by time; what held at the end of a range is carried on by one row for each range.
    """
    held = F.struct(*by, *[F.col(v).alias(f"v_{v}") for v in values])
    keyed = F.lit(True)
    for c in [*by, at]:
        keyed &= F.col(c).isNotNull()
    told = right.filter(keyed).select(*by, F.col(at).alias("at_"), F.lit(0).alias("side_"), held.alias("held_"))
    asked = left.select(*by, F.col(at).alias("at_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("row_"))
    order = [*by, "at_", "side_", "held_"]
    dealt = asked.unionByName(told, allowMissingColumns=True).repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    rows = saved(dealt, "as-of")
    # one row for each range
    ends = rows.filter("side_ = 0").groupBy("part_").agg(F.max_by("held_", F.struct(*order)).alias("end_"))
    parts = rows.select("part_").distinct().join(ends, "part_", "left")
    before = F.last("end_", ignorenulls=True).over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("part_", before.alias("carried_"))
    within = F.last("held_", ignorenulls=True).over(Window.partitionBy("part_").orderBy(*[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("within_", within).filter("side_ = 1").join(carried, "part_", "left")

    def own(c: str) -> Column:
        same = F.col("at_").isNotNull()
        for k in by:
            same &= F.col(f"{c}.{k}") == F.col(k)
        return F.when(same, F.col(c))

    last = F.coalesce(own("within_"), own("carried_"))
    return found.select("row_.*", *[last[f"v_{v}"].alias(v) for v in values])


def _cells(df: DataFrame, start: str, end: str, width: float, side: str) -> DataFrame:
    """A row for each level from an interval's own one on, and for each of the two cells at most that it touches there."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.0)) / F.lit(float(width))
    level = F.when(length <= 1, F.lit(0)).otherwise(F.ceil(F.log2(length))).cast("int")
    out = df.filter(F.col(start) <= F.col(end)).withColumn(f"{side}level", F.least(level, F.lit(LEVELS - 1)))
    out = out.withColumn("level_", F.explode(F.sequence(F.col(f"{side}level"), F.lit(LEVELS - 1))))
    cell = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("level_"))))
    return out.withColumn("cell_", F.explode(F.sequence(cell(start), cell(end))))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pairs of intervals of the same ``by`` that share an instant: by, and the other columns of both sides, which must have other names.

    Both sides have (l_start, l_end) and (r_start, r_end) in seconds.  Each interval lies on a grid as coarse as it is long, so it
    touches two cells at most however long it is; a pair meets at the coarser one's grid, in the cell where the later one begins.
    Intervals that end before they start, and null ends, meet nothing.
    """
    x, y = _cells(left, "l_start", "l_end", width, "l_"), _cells(right, "r_start", "r_end", width, "r_")
    begin = F.floor(F.greatest("l_start", "r_start") / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("level_"))))
    both = x.join(y, [*by, "level_", "cell_"])
    meet = (F.col("level_") == F.greatest("l_level", "r_level")) & (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) & (F.col("cell_") == begin)
    return both.filter(meet).drop("level_", "cell_", "l_level", "r_level")


def counters_of_all(rows: DataFrame, *by: str) -> DataFrame:
    """``counters`` for each combination of ``by``, with and without each of them (null: all), and grouping: which ones are left out, as bits."""
    parts = [f"c_{k}" for k in range(len(by))]
    marked = rows.select("*", *[F.struct(F.col(c)).alias(p) for c, p in zip(by, parts, strict=True)])
    # the counts of the finest groups are added up: rows are read once, whatever the number of combinations
    fine = counters(marked, *parts)
    sums = [c for c in fine.columns if c not in parts]
    out = fine.cube(*parts).agg(F.grouping_id().alias("grouping"), *[F.sum(c).alias(c) for c in sums])
    return out.select(*[F.col(p)[c].alias(c) for c, p in zip(by, parts, strict=True)], "grouping", *sums)


def sketched(owners: DataFrame, day: str, key: str, name: str, bits: int = 12) -> DataFrame:
    """(day, key, sketch): a mergeable sketch of each day's different names of a key; it is kept, and days are added as they come."""
    return owners.groupBy(day, key).agg(F.hll_sketch_agg(F.col(name), bits).alias("sketch"))


def shared_by_many(sketches: DataFrame, owners: DataFrame, key: str, name: str, least: int, margin: float = 0.1) -> DataFrame:
    """(key, many): whether ``least`` different names hold a key, from the union of its daily sketches.

    Keys whose estimate is within ``margin`` of the threshold (two at least) are counted exactly; only their rows are read again.
    """
    whole = sketches.groupBy(key).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    near = F.abs(F.col("about") - least) <= max(2.0, margin * least)
    open_ = whole.filter(near).select(key)
    exact = owners.join(open_, key, "left_semi").groupBy(key).agg(F.count_distinct(name).alias("exact"))
    return whole.join(exact, key, "left").select(key, (F.coalesce("exact", "about") >= least).alias("many"))
