"""Rows of a sheet: one resolution for many rows, what to write, counters, links, pages and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import is_blank, strip


def country_key(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def groups(rows: DataFrame) -> DataFrame:
    """(source_key, country_key, source_value, country, n_rows): each identity once, as its first row spells it. rows need source_key."""
    keyed = rows.filter("source_key IS NOT NULL").withColumn("country_key", country_key(F.col("country")))
    first = F.min_by(F.struct("source_value", "country"), "original_row")
    out = keyed.groupBy("source_key", "country_key").agg(first.alias("f"), F.count("*").alias("n_rows"))
    return out.select("source_key", "country_key", "f.source_value", "f.country", "n_rows")


def fanned_out(rows: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Every row with the resolution of its (source_key, country_key)."""
    keyed = rows.withColumn("country_key", country_key(F.col("country")))
    return keyed.join(resolutions, ["source_key", "country_key"], "left")


def states(spark) -> DataFrame:
    """The state table as rows."""
    data = [(*k, *v) for k, v in config.STATES.items()]
    return spark.createDataFrame(data, "source_platform string, source_status string, decision string, target_status string, state_case string, write_id boolean")


def _remark(platform: Column, has_source: Column, has_target: Column) -> Column:
    no_target = F.when(platform == "kick", config.REMARK_NO_TARGET["twitch"]).otherwise(config.REMARK_NO_TARGET["kick"])
    no_source = F.when(platform == "kick", config.REMARK_NO_SOURCE["kick"]).otherwise(config.REMARK_NO_SOURCE["twitch"])
    return F.when(has_source & has_target, F.lit(None).cast("string")).when(has_source, no_target).when(has_target, no_source).otherwise(config.REMARK_NEITHER)


def transitions(rows: DataFrame, policy: str = "preserve") -> DataFrame:
    """What each resolved row writes: status, destination, remarks, write_destination, write_remarks, state_case.

    rows: source_platform, source_status, decision, target_status, matched_id, existing_destination,
    existing_remarks.  A state outside the table, or a match without an id, raises.
    """
    table = states(rows.sparkSession)
    status = F.when(F.col("source_status") == "NOT_FOUND", F.col("target_status"))
    keyed = rows.withColumn("t_status", status)
    same = [keyed[c].eqNullSafe(table[c]) for c in ("source_platform", "source_status", "decision")]
    # the state table has a fixed handful of rows
    out = keyed.join(F.broadcast(table), [*same, keyed["t_status"].eqNullSafe(table["target_status"])], "left")
    out = out.select(*[keyed[c] for c in rows.columns], table["state_case"].alias("base_case"), table["write_id"].alias("write_id"))
    has_id = F.coalesce("matched_id", F.lit("")) != ""
    message = F.concat_ws(" ", F.lit("undefined state"), "source_platform", "source_status", "decision", "target_status", "matched_id")
    wrong = F.col("base_case").isNull() | (F.col("write_id") & ~has_id)
    base = F.when(wrong, F.raise_error(message).cast("string")).otherwise(F.col("base_case"))
    out = out.withColumn("base_case", base)
    destination = F.when(F.col("write_id"), F.col("matched_id"))
    remark = _remark(F.col("source_platform"), F.col("source_status") == "EXISTS", has_id)
    final = F.when(F.col("source_status") == "NOT_FOUND", F.when(F.col("write_id"), "MATCH").otherwise("SOURCE_NOT_FOUND")).otherwise(F.col("decision"))
    filled = ~is_blank(F.col("existing_destination"))
    kept = filled & F.lit(policy == "preserve")
    blank_remark = is_blank(F.col("existing_remarks"))
    own = F.coalesce(strip(F.col("existing_remarks")).isin(config.OWN_REMARKS), F.lit(False))
    old = F.coalesce(strip(F.col("existing_remarks")).isin(config.OLD_REMARKS), F.lit(False))
    write_destination = F.when(kept, F.lit(False)).when(filled, destination.isNotNull()).otherwise(destination.isNotNull() | F.col("existing_destination").isNotNull())
    write_remarks = F.when(kept, old).when(remark.isNotNull(), blank_remark | own).otherwise(own | (F.col("existing_remarks").isNotNull() & blank_remark))
    return out.select(
        *rows.columns, F.when(kept, "PRESERVED").otherwise(final).alias("status"), F.when(~kept, destination).alias("destination"), F.when(~kept, remark).alias("remarks"),
        write_destination.alias("write_destination"), write_remarks.alias("write_remarks"), F.concat("base_case", F.when(kept, "_PRESERVED").otherwise("")).alias("state_case"),
    )


def outcome_without_write(rows: DataFrame, status: str, case: str) -> DataFrame:
    """Rows that write nothing: empty sources (SKIPPED_EMPTY, EMPTY_SOURCE) and errors."""
    nothing = F.lit(None).cast("string")
    return rows.select(*rows.columns, F.lit(status).alias("status"), nothing.alias("destination"), nothing.alias("remarks"), F.lit(False).alias("write_destination"), F.lit(False).alias("write_remarks"), F.lit(case).alias("state_case"))


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of a job's rows: status, decision, manual_verdict."""
    status = F.col("status")
    done = ~status.isin("PENDING", "SOURCE_EXISTS")
    error = status.isin(config.ERROR_STATUSES)
    skipped = status.isin("SKIPPED_EMPTY", "PRESERVED")
    match = status == "MATCH"
    review = F.coalesce(F.col("decision") == "REVIEW", F.lit(False)) & (F.coalesce("manual_verdict", F.lit("")) == "")
    rest = done & ~error & ~skipped & ~match
    named = {
        "total_rows": F.lit(True), "processed_rows": done, "error_count": error, "skipped_count": skipped, "match_count": match,
        "review_count": rest & review, "no_match_count": rest & ~review, "not_found_count": status == "SOURCE_NOT_FOUND",
    }
    return rows.groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in named.items()])


def job_status(counted: DataFrame) -> DataFrame:
    """Adds job_status: FAILED, CANCELLED, PARTIAL or COMPLETED. counted may have failed and cancelled flags."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in counted.columns else F.lit(False)
    return counted.withColumn("job_status", F.when(flag("failed"), "FAILED").when(flag("cancelled"), "CANCELLED").when(F.col("error_count") > 0, "PARTIAL").otherwise("COMPLETED"))


def display_decision(status: Column, decision: Column, verdict: Column) -> Column:
    """One of seven words for a row."""
    return (
        F.when(status.isin("PENDING", "SOURCE_EXISTS"), "PENDING")
        .when(status.isin(config.ERROR_STATUSES), "ERROR")
        .when(status.isin("SKIPPED_EMPTY", "PRESERVED"), "SKIPPED")
        .when(status == "MATCH", "MATCH")
        .when((decision == "REVIEW") & (F.coalesce(verdict, F.lit("")) == ""), "REVIEW")
        .when(status == "SOURCE_NOT_FOUND", "NOT_FOUND")
        .otherwise("NO_MATCH")
    )


def channel_links(rows: DataFrame) -> DataFrame:
    """Adds source_link and target_link: a channel address of the source if it exists, of the other platform only for a match."""
    other = F.when(F.col("source_platform") == "kick", "twitch").otherwise("kick")

    def address(platform: Column, username: Column) -> Column:
        return F.concat(F.when(platform == "twitch", config.HANDLE_RULES["twitch"]["url"]).otherwise(config.HANDLE_RULES["kick"]["url"]), username)

    untouched = F.col("status").isin("SKIPPED_EMPTY", "PRESERVED")
    source = F.when(~untouched & (F.col("source_status") == "EXISTS"), F.coalesce("source_url", address(F.col("source_platform"), F.col("source_key"))))
    target = F.when(~untouched & (F.col("decision") == "MATCH") & F.col("matched_id").isNotNull(), F.coalesce("target_url", address(other, F.lower("matched_id"))))
    return rows.withColumn("source_link", source).withColumn("target_link", target)


def grid(rows: DataFrame, decision: str | None = None, status: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows in sheet order, with the number of rows that pass the filter. ERROR stands for all error states."""
    if decision:
        rows = rows.filter(F.col("decision") == decision)
    if status:
        rows = rows.filter(F.col("status").isin(config.ERROR_STATUSES) if status == "ERROR" else F.col("status") == status)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("original_row").offset(offset).limit(max(1, min(1000, limit)))
    return page.join(F.broadcast(total))  # one row


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at")).limit(max(1, min(200, limit)))


def best_candidate(candidates: Column, *wanted: Column) -> Column:
    """The first candidate whose username is wanted, else the first."""
    names = F.array_compact(F.array(*wanted))
    return F.coalesce(F.try_element_at(F.filter(candidates, lambda c: F.array_contains(names, c["username"])), F.lit(1)), F.try_element_at(candidates, F.lit(1)))


def review_queue(rows: DataFrame, include_decided: bool = False) -> DataFrame:
    """Final rows that need a human, with up to five other candidates. rows: candidates array<struct<username, decision, ...>>."""
    open_ = rows.filter((F.col("decision") == "REVIEW") & F.col("status").isin(config.FINAL_STATUSES))
    if not include_decided:
        open_ = open_.filter(F.coalesce("manual_verdict", F.lit("")) == "")
    others = F.slice(F.filter("candidates", lambda c: c["decision"].isin("MATCH", "REVIEW")), 1, 5)
    return open_.withColumn("candidate", best_candidate(F.col("candidates"), F.col("review_candidate"), F.lower("matched_id"))).withColumn("other_candidates", others).orderBy("original_row")


def verdict_fanout(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows that a verdict touches: all of its source, but preserved and empty ones. verdicts: (source_key, ...)."""
    return rows.filter(~F.col("status").isin("PRESERVED", "SKIPPED_EMPTY")).join(verdicts.select("source_key").distinct(), "source_key", "left_semi")


def retry_failed(rows: DataFrame) -> DataFrame:
    """Error rows wait again; the rest stays."""
    failed = F.col("status").isin(config.ERROR_STATUSES)
    return rows.withColumn("status", F.when(failed, "PENDING").otherwise(F.col("status")))


def unfinished(rows: DataFrame) -> DataFrame:
    """The rows that a resumed run still has to do, in sheet order."""
    return rows.filter(F.col("status").isin("PENDING", "SOURCE_EXISTS")).orderBy("original_row")


def stale(jobs: DataFrame, now: Column, after: str = "10 minutes") -> DataFrame:
    """Jobs that claim to run but haven't moved."""
    return jobs.filter((F.col("status") == "PROCESSING") & (F.col("updated_at") < now - F.expr(f"interval {after}")))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds place: each row's number within ``by``, in ``order``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
