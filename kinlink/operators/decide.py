"""From evidence to decisions: scores and gates of a pair, the decision of a source, final rules and human verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import Scoring
from ..functions import text as X

POSITIVE = ("strong", "supporting")


def points(signals: Column, w: Scoring) -> Column:
    """The sum of the available signals' points; what names can add is capped."""

    def total(keep) -> Column:
        return F.aggregate(F.filter(signals, lambda s: s["available"] & keep(s)), F.lit(0.0), lambda t, s: t + s["points"])

    names = total(lambda s: (s["family"] == "name") & (s["points"] > 0))
    against = total(lambda s: (s["family"] == "name") & (s["points"] < 0))
    return F.least(names, F.lit(w.name_family_cap)) + against + total(lambda s: s["family"] != "name")


def confidence(points: Column, w: Scoring) -> Column:
    """0 to 100, rising ever slower."""
    return F.when(points <= 0, 0.0).otherwise(100.0 * (1.0 - F.exp(-points / w.confidence_scale)))


def _families(signals: Column, strengths: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(signals, lambda s: s["available"] & s["strength"].isin(*strengths)), lambda s: s["family"])))


def _any(signals: Column, strength: str) -> Column:
    return F.exists(signals, lambda s: s["available"] & (s["strength"] == strength))


def signal_of(signals: Column, name: str) -> Column:
    return F.try_element_at(F.filter(signals, lambda s: s["name"] == name), F.lit(1))


def promising(signals: Column, w: Scoring) -> Column:
    """Worth comparing pictures."""
    return _any(signals, "strong") | (points(signals, w) >= w.image_prefilter_points)


def evaluated(pairs: DataFrame, w: Scoring = Scoring()) -> DataFrame:
    """Adds points, confidence, strong, supporting, corroborated, contradicted and decision to pairs with signals.

    MATCH needs a strong family, confidence, a second independent family or mutual links, and nothing against it.
    """
    s = F.col("signals")
    link = signal_of(s, "cross_link")
    mutual = F.coalesce((link["data"]["forward"] == "true") & (link["data"]["backward"] == "true") & link["available"], F.lit(False))
    out = pairs.withColumn("points", points(s, w)).withColumn("strong", _families(s, ("strong",)))
    out = out.withColumn("supporting", F.array_remove(F.array_except(_families(s, POSITIVE), "strong"), "country"))
    n_strong = F.size("strong")
    out = out.withColumn("corroborated", (n_strong >= 2) | ((n_strong == 1) & (F.size("supporting") >= 1)) | mutual)
    out = out.withColumn("conflict", _any(s, "conflict"))
    out = out.withColumn("contradicted", _any(s, "negative") & ~F.arrays_overlap("strong", F.array(F.lit("link"), F.lit("social"))))
    cap = w.match_threshold - 1.0
    raw = confidence(F.col("points"), w)
    raw = F.when(n_strong == 0, F.least(raw, F.lit(cap))).otherwise(raw)
    out = out.withColumn("raw", raw)
    match = (n_strong > 0) & (F.col("raw") >= w.match_threshold) & F.col("corroborated") & ~F.col("contradicted")
    review = (F.col("raw") >= w.review_threshold) | (n_strong > 0)
    known = F.arrays_overlap("strong", F.array(F.lit("social"), F.lit("image")))
    decision = F.when(F.col("conflict"), F.when(known, "REVIEW").otherwise("NO_MATCH")).when(match, "MATCH").when(review, "REVIEW").otherwise("NO_MATCH")
    out = out.withColumn("decision", decision)
    capped = F.col("conflict") | ((F.col("decision") == "REVIEW") & F.col("contradicted"))
    return out.withColumn("confidence", F.bround(F.when(capped, F.least("raw", F.lit(cap))).otherwise(F.col("raw")), 1)).drop("raw")


def _order(*keys: Column) -> list[Column]:
    return [*keys, F.col("ord"), F.col("handle")]


def aggregated(pairs: DataFrame) -> DataFrame:
    """(source_key, decision, best, n_matches, candidate_count): one match is a match, several need a review, else the best review or none."""
    rank = F.when(F.col("decision") == "MATCH", 2).when(F.col("decision") == "REVIEW", 1).otherwise(0)
    by = Window.partitionBy("source_key").orderBy(*_order(F.desc("rank"), F.desc("confidence"), F.desc("points")))
    first = pairs.withColumn("rank", rank).withColumn("place", F.row_number().over(by))
    out = first.groupBy("source_key").agg(
        F.count_if(F.col("decision") == "MATCH").alias("n_matches"), F.count("*").alias("candidate_count"),
        F.max_by("handle", F.when(F.col("place") == 1, 1)).alias("best"), F.max_by("decision", F.when(F.col("place") == 1, 1)).alias("top"), F.max_by("confidence", F.when(F.col("place") == 1, 1)).alias("confidence"),
    )
    return out.withColumn("decision", F.when(F.col("n_matches") > 1, "REVIEW").otherwise(F.col("top"))).drop("top")


def stored(pairs: DataFrame, best: DataFrame, most: int = Scoring().stored_candidates) -> DataFrame:
    """The candidates that are kept for a source, as ranked; its best is always among them. best: (source_key, best)."""
    by = Window.partitionBy("source_key").orderBy(*_order(F.desc("confidence"), F.desc("points")))
    placed = pairs.join(best.select("source_key", "best"), "source_key", "left").withColumn("place", F.row_number().over(by))
    is_best = F.coalesce(F.col("handle") == F.col("best"), F.lit(False))
    shifted = F.max(F.when(is_best & (F.col("place") > most), 1).otherwise(0)).over(Window.partitionBy("source_key"))
    place = F.when(shifted == 1, F.when(is_best, 1).otherwise(F.col("place") + 1)).otherwise(F.col("place"))
    return placed.withColumn("place", place).filter(F.col("place") <= most).drop("best")


def rule_hits(s: Column, c: Column, signals: Column) -> Column:
    """Which of the final rules a candidate meets."""
    same_picture = F.coalesce(signal_of(signals, "profile_image")["strength"] == "strong", F.lit(False))
    bio = X.same_bio(s["description"], c["description"]) | X.same_bio(s["extra_bio"], c["description"])
    hits = F.array(*[F.when(ok, F.lit(name)) for ok, name in zip((X.same_name(s["username"], c["username"]), same_picture, bio), config.RULES, strict=True)])
    return F.filter(hits, lambda h: h.isNotNull())


def contradictions(s: Column, c: Column, sheet_country: Column, signals: Column, hits: Column) -> Column:
    """What speaks against a candidate that meets a rule."""
    ca, cb = (F.lower(X.strip(F.coalesce(p["category"], F.lit("")))) for p in (s, c))
    la, lb = X.normalize_language(s["language"]), X.normalize_language(c["language"])
    different = (ca != "") & (cb != "") & (ca != cb) & ~X.one_of(ca, config.GENERIC_CATEGORIES) & ~X.one_of(cb, config.GENERIC_CATEGORIES)
    langs = X.country_languages(sheet_country)
    picture, link = signal_of(signals, "profile_image")["strength"], signal_of(signals, "cross_link")["strength"]
    found = F.array(
        F.when(different, F.lit("category")),
        F.when(la != lb, F.lit("language")),
        F.when(~F.array_contains(langs, lb), F.lit("country")),
        F.when((picture == "negative") & ~F.array_contains(hits, config.RULES[1]), F.lit("picture")),
        F.when(link == "conflict", F.lit("linked elsewhere")),
    )
    return F.filter(found, lambda p: p.isNotNull())


def ruled(pairs: DataFrame) -> DataFrame:
    """(source_key, decision, target, why): the final decision of sources that exist, from stored candidates.

    pairs: place, handle, decision, confidence, hits, problems, rejected.  A rule hit counts if nothing links it
    elsewhere and it is one of two hits or has no problem.  The best hit must be alone at the top.
    """
    live = pairs.filter(~F.coalesce("rejected", F.lit(False)))
    n = F.size("hits")
    sure = (n > 0) & ~F.array_contains("problems", "linked elsewhere") & ((n >= 2) | (F.size("problems") == 0))
    kind = F.when(sure, 3).when(n > 0, 2).when(F.col("decision").isin("MATCH", "REVIEW"), 1).otherwise(0)
    rule = F.array_position(F.array(*map(F.lit, config.RULES)), F.try_element_at("hits", F.lit(1)))
    strength = F.when(kind == 3, n).when(kind == 2, n).otherwise(F.coalesce("confidence", F.lit(0.0)))
    live = live.withColumn("kind", kind).withColumn("strength", strength.cast("double")).withColumn("rule", F.when(kind == 3, rule).otherwise(F.lit(0)))
    by = Window.partitionBy("source_key").orderBy(F.desc("kind"), F.desc("strength"), "rule", "place", "handle")
    whole = Window.partitionBy("source_key")
    top = live.withColumn("first", F.row_number().over(by)).withColumn("most", F.max(F.when(F.col("kind") == 3, F.col("strength"))).over(whole))
    top = top.withColumn("equal", F.sum(F.when((F.col("kind") == 3) & (F.col("strength") == F.col("most")), 1).otherwise(0)).over(whole)).filter("first = 1")
    decision = F.when((F.col("kind") == 3) & (F.col("equal") == 1), "MATCH").when(F.col("kind") > 0, "REVIEW").otherwise("NO_MATCH")
    why = F.when(F.col("kind") == 3, F.when(F.col("equal") == 1, F.array_join("hits", " + ")).otherwise("several accounts fit equally well")).when(F.col("kind") == 2, F.concat(F.array_join("hits", " + "), F.lit(", but "), F.array_join("problems", "; "))).when(F.col("kind") == 1, "near miss").otherwise("")
    return top.select("source_key", decision.alias("decision"), F.when(F.col("kind") > 0, F.col("handle")).alias("target"), why.alias("why"))


def ruled_missing(pairs: DataFrame) -> DataFrame:
    """(source_key, decision, target, target_status) of sources that don't exist: the first live same-name account, unless its language doesn't fit."""
    live = pairs.withColumn("live", ~F.coalesce("rejected", F.lit(False)))
    first = live.groupBy("source_key").agg(F.min_by(F.struct("handle", "problems"), F.when(F.col("live"), F.struct("place", "handle"))).alias("best"), F.count("*").alias("n"), F.count_if("live").alias("n_live"))
    decision = F.when(F.col("n_live") == 0, "NO_MATCH").when(F.size("best.problems") > 0, "REVIEW").otherwise("MATCH")
    out = first.withColumn("decision", decision)
    status = F.when(F.col("decision") == "MATCH", "VERIFIED").when(F.col("n") > 0, "EXISTS_UNVERIFIED").otherwise("NOT_FOUND")
    return out.select("source_key", "decision", F.when(F.col("decision") != "NO_MATCH", F.col("best.handle")).alias("target"), status.alias("target_status"))


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """(source_key, target_key, verdict): the last one of each pair."""
    return verdicts.groupBy("source_key", "target_key").agg(F.max_by("verdict", "updated_at").alias("verdict"))


def overlaid(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds verdict and rejected to candidates, from (source_key, target_key, verdict)."""
    known = verdicts.select("source_key", F.col("target_key").alias("handle"), "verdict")
    return pairs.join(known, ["source_key", "handle"], "left").withColumn("rejected", F.coalesce(F.col("verdict") == "REJECTED", F.lit(False)))


def reviewed(pairs: DataFrame) -> DataFrame:
    """(source_key, decision, target, confidence, manual) of sources that have a verdict, from overlaid candidates.

    A confirmed candidate is the match.  Rejected ones go, and one remaining match is a match, else the best review.
    """
    state = F.when(F.col("verdict") == "CONFIRMED", 3).when(F.col("rejected"), -1).when(F.col("decision") == "MATCH", 2).when(F.col("decision") == "REVIEW", 1).otherwise(0)
    marked = pairs.withColumn("state", state)
    strength = F.when(F.col("state") == 1, F.coalesce("confidence", F.lit(0.0))).otherwise(F.lit(0.0))
    by = Window.partitionBy("source_key").orderBy(F.desc("state"), strength.desc(), "place", "handle")
    whole = Window.partitionBy("source_key")
    top = marked.withColumn("first", F.row_number().over(by)).withColumn("touched", F.max(F.col("verdict").isNotNull()).over(whole)).withColumn("matches", F.sum(F.when(F.col("state") == 2, 1).otherwise(0)).over(whole)).filter("first = 1 AND touched")
    decision = F.when(F.col("state") == 3, "MATCH").when((F.col("state") == 2) & (F.col("matches") == 1), "MATCH").when(F.col("state") > 0, "REVIEW").otherwise("NO_MATCH")
    conf = F.when(F.col("state") == 3, 100.0).when(F.col("state") > 0, F.col("confidence"))
    return top.select("source_key", decision.alias("decision"), F.when(F.col("state") > 0, F.col("handle")).alias("target"), conf.alias("confidence"), F.lit(True).alias("manual"))


def evidence(signals: Column) -> Column:
    """The signals as one flat struct."""

    def score(name: str) -> Column:
        s = signal_of(signals, name)
        return F.when(s["available"], F.bround(s["score"], 4))

    def fact(name: str, key: str) -> Column:
        return F.coalesce(signal_of(signals, name)["data"][key] == "true", F.lit(False))

    def strong(name: str, strength: str) -> Column:
        return F.coalesce(signal_of(signals, name)["strength"] == strength, F.lit(False))

    similar = [score(n).alias(f"{n}_similarity") for n in ("username", "display_name", "profile_image", "bio", "content")]
    shared = F.coalesce(signal_of(signals, "shared_socials")["data"]["shared_unique"], F.lit("")).alias("shared_social_accounts")
    matches = [fact("shared_socials", f"{k}_match").alias(f"{k}_match") for k in ("instagram", "youtube", "x", "tiktok")]
    country = signal_of(signals, "country")
    return F.struct(*similar, fact("profile_image", "generic").alias("profile_image_generic"), strong("cross_link", "strong").alias("explicit_cross_link"), strong("cross_link", "conflict").alias("cross_link_conflict"), strong("shared_socials", "strong").alias("social_link_match"), shared, *matches, F.coalesce(country["available"] & (country["points"] > 0), F.lit(False)).alias("country_match"))


def reason(signals: Column) -> Column:
    """What speaks for and against, strongest first."""
    order = lambda a, b: F.when(a["points"] > b["points"], -1).when(a["points"] < b["points"], 1).otherwise(0)
    told = lambda s: F.concat(s["name"], F.lit(" "), F.format_string("%.0f%%", 100 * F.coalesce(s["score"], F.lit(0.0))))
    parts = [F.transform(F.array_sort(F.filter(signals, keep), order), told) for keep in (lambda s: s["points"] > 0, lambda s: (s["points"] < 0) | s["strength"].isin("conflict", "negative"))]
    return reduce(F.concat, [F.lit("for: "), F.array_join(parts[0], ", "), F.lit("; against: "), F.array_join(parts[1], ", ")])
