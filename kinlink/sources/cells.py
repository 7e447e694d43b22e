"""Sheets as cell tables (sheet, row, col, value): finding the header, reading rows, and what a run has to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import cell_text, is_blank, normalize_header, strip

KNOWN = ["id_kick", "id_twitch", "country", "remarks", "twitch_id_link", "kick_id_link"]
HEADER_ROWS, MAX_ROWS = 20, 200_000


def header(cells: DataFrame) -> DataFrame:
    """(sheet, header_row, columns): the first row of each sheet, among its first 20, that has both id columns. columns: map of name to number."""
    top = cells.filter(F.col("row") <= HEADER_ROWS).withColumn("name", normalize_header(F.col("value"))).filter(F.col("name").isin(KNOWN))
    named = top.groupBy("sheet", "row", "name").agg(F.min("col").alias("col"))
    found = named.groupBy("sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "col")))).alias("columns"))
    both = found.filter(F.map_contains_key("columns", "id_kick") & F.map_contains_key("columns", "id_twitch"))
    return both.groupBy("sheet").agg(F.min("row").alias("header_row"), F.min_by("columns", "row").alias("columns"))


def last_data_row(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, last): the last row with anything in a named column."""
    used = cells.join(headers, "sheet").filter((F.col("row") > F.col("header_row")) & F.array_contains(F.map_values("columns"), F.col("col")) & ~is_blank(F.col("value")))
    return used.groupBy("sheet").agg(F.max("row").alias("last"))


def rows(cells: DataFrame, headers: DataFrame, platform: str) -> DataFrame:
    """(sheet, original_row, source_value, country, existing_destination, existing_remarks) of every row to the last one in use, empty rows too."""
    last = last_data_row(cells, headers)
    span = headers.join(last, "sheet").select("sheet", "columns", F.explode(F.sequence(F.col("header_row") + 1, F.col("last"))).alias("original_row"))
    named = cells.join(headers, "sheet").select("sheet", F.col("row").alias("original_row"), F.try_element_at(F.map_from_arrays(F.map_values("columns"), F.map_keys("columns")), F.col("col")).alias("name"), cell_text(F.col("value")).alias("text"))
    flat = named.filter("name IS NOT NULL").groupBy("sheet", "original_row").pivot("name", KNOWN).agg(F.first("text"))
    source, target = f"id_{platform}", f"id_{config.OTHER_PLATFORM[platform]}"
    out = span.join(flat, ["sheet", "original_row"], "left")
    return out.select("sheet", "original_row", F.col(source).alias("source_value"), "country", F.col(target).alias("existing_destination"), F.col("remarks").alias("existing_remarks"))


def fill_rates(rows: DataFrame, *columns: str) -> DataFrame:
    """The share of rows with something in each column."""
    return rows.agg(*[F.avg((~is_blank(F.col(c))).cast("int")).alias(c) for c in columns])


def detected_platform(kick_first, kick_rate, twitch_rate):
    """The source platform: the first id column, unless the fill rates say otherwise by over a fifth (then null)."""
    by_order = F.when(kick_first, "kick").otherwise("twitch")
    by_fill = F.when(kick_rate > twitch_rate + 0.2, "kick").when(twitch_rate > kick_rate + 0.2, "twitch")
    return F.when(by_fill.isNull() | (by_fill == by_order), by_order)


def malformed(rows: DataFrame, most: int = 25) -> DataFrame:
    """The first rows whose source has spaces within or is too long."""
    bare = strip(F.col("source_value"))
    return rows.filter(bare.contains(" ") | (F.length(bare) > 64)).orderBy("original_row").limit(most)


def checked_size(rows: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """The rows; an error if there are more than the limit."""
    n = rows.agg(F.count("*").alias("n")).first().n
    if n > most:
        raise ValueError(f"too many rows ({n}); the limit is {most}")
    return rows


def planned_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, header, col, is_new): where remarks and links go; columns that aren't there come after the last one in use."""
    used = cells.filter(F.coalesce("value", F.lit("")) != "").groupBy("sheet").agg(F.max("col").alias("last"))
    wanted = headers.join(used, "sheet").select("sheet", "columns", "last", F.posexplode(F.array(*map(F.lit, ["remarks", "twitch_id_link", "kick_id_link"]))).alias("pos", "header"))
    there = F.try_element_at("columns", F.col("header"))
    new = F.sum(F.when(there.isNull(), 1).otherwise(0)).over(Window.partitionBy("sheet").orderBy("pos"))
    return wanted.select("sheet", "header", F.coalesce(there, F.col("last") + new).cast("int").alias("col"), there.isNull().alias("is_new"))


def expected_cells(writes: DataFrame, columns: dict[str, int], sheet: str, header_row: int = 1) -> DataFrame:
    """(sheet, row, col, value) that the output must hold.

    writes: original_row, write_destination, destination, write_remarks, remarks, and target_link and source_link
    where links are written.  Two writes of a row, writes to the header, and values like formulas raise.
    """
    several = F.count("*").over(Window.partitionBy("original_row"))
    guarded = writes.withColumn("n", several).withColumn(
        "original_row",
        F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate write for row "), "original_row")).cast("int"))
        .when(F.col("original_row") <= header_row, F.raise_error(F.concat(F.lit("refusing to write into the header, row "), "original_row")).cast("int"))
        .otherwise(F.col("original_row")),
    )
    places = [(columns["destination"], F.col("write_destination"), F.col("destination")), (columns["remarks"], F.col("write_remarks"), F.col("remarks"))]
    places += [(columns[c], F.lit(True), F.col(c)) for c in ("source_link", "target_link") if c in columns and c in writes.columns]
    cells = F.array(*[F.when(ok, F.struct(F.lit(col).alias("col"), value.alias("value"))) for col, ok, value in places])
    flat = guarded.select(F.lit(sheet).alias("sheet"), F.col("original_row").alias("row"), F.inline(F.filter(cells, lambda c: c.isNotNull())))
    formula = F.raise_error(F.lit("refusing to write a value like a formula")).cast("string")
    return flat.withColumn("value", F.when(F.col("value").startswith("="), formula).otherwise(F.col("value")))


def written(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """The cells after the writes; a null value empties a cell."""
    keys = ["sheet", "row", "col"]
    new = expected.select(*keys, F.col("value").alias("new"), F.lit(True).alias("is_new"))
    out = cells.join(new, keys, "full_outer")
    return out.select(*keys, F.when(F.col("is_new"), F.col("new")).otherwise(F.col("value")).alias("value")).filter("value IS NOT NULL")


def differences(original: DataFrame, output: DataFrame, expected: DataFrame) -> DataFrame:
    """(sheet, row, col, wanted, found): cells of the output that are neither as before nor as expected."""
    keys = ["sheet", "row", "col"]
    a = original.select(*keys, F.col("value").alias("before"))
    b = output.select(*keys, F.col("value").alias("found"))
    e = expected.select(*keys, F.col("value").alias("new"), F.lit(True).alias("is_new"))
    every = a.join(b, keys, "full_outer").join(e, keys, "full_outer")
    wanted = F.when(F.col("is_new"), F.col("new")).otherwise(F.col("before"))
    return every.select(*keys, wanted.alias("wanted"), "found").filter(~F.col("wanted").eqNullSafe(F.col("found")))


def moved_rows(rows: DataFrame, output: DataFrame, source_col: int) -> DataFrame:
    """Rows whose source value is not in its row of the output."""
    there = output.filter(F.col("col") == source_col).select("sheet", F.col("row").alias("original_row"), cell_text(F.col("value")).alias("found"))
    return rows.join(there, ["sheet", "original_row"], "left").filter(~F.col("source_value").eqNullSafe(F.col("found")))


def verified(original: DataFrame, output: DataFrame, expected: DataFrame, rows: DataFrame, source_col: int, most: int = 50) -> DataFrame:
    """One row: ok, and the first mismatches. The gate before a sink."""
    wrong = differences(original, output, expected).select("sheet", "row", "col", "wanted", "found")
    moved = moved_rows(rows, output, source_col).select("sheet", F.col("original_row").alias("row"), F.lit(source_col).alias("col"), F.col("source_value").alias("wanted"), "found")
    every = wrong.unionByName(moved)
    first = every.orderBy("sheet", "row", "col").limit(most).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("mismatches"))
    return every.agg(F.count("*").alias("n")).join(F.broadcast(first)).select((F.col("n") == 0).alias("ok"), F.col("n").alias("n_mismatches"), "mismatches")
