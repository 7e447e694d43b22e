"""The evidence about a pair: each signal as struct(name, family, available, score, points, strength, data)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..config import Scoring
from ..functions import text as X
from ..functions import udfs
from ..functions.links import website_is_personal

SIGNAL = "struct<name:string,family:string,available:boolean,score:double,points:double,strength:string,data:map<string,string>>"


def signal(name: str, family: str, available: Column, score: Column, points: Column, strength: Column, **data: Column) -> Column:
    facts = F.create_map(*[x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]) if data else F.create_map().cast("map<string,string>")
    score = F.when(available, score.cast("double"))
    points = F.when(available, points.cast("double")).otherwise(F.lit(0.0))
    strength = F.when(available, strength).otherwise("none")
    return F.struct(F.lit(name).alias("name"), F.lit(family).alias("family"), available.alias("available"), score.alias("score"), points.alias("points"), strength.alias("strength"), facts.alias("data")).cast(SIGNAL)


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _links(identities: Column, platform: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(identities, lambda i: i["kind"] == platform), lambda i: i["identity"])))


def cross_link(s: Column, c: Column, w: Scoring) -> Column:
    """A profile links to the other: identity. It links to another account there: conflict."""
    to_c, to_s = _links(s["identities"], c["platform"]), _links(c["identities"], s["platform"])
    forward = F.array_contains(to_c, X.canonical_handle(c["platform"], c["username"]))
    backward = F.array_contains(to_s, X.canonical_handle(s["platform"], s["username"]))
    linked = forward | backward
    points = F.when(linked, w.cross_link_weight + F.when(forward & backward, w.mutual_link_bonus).otherwise(0.0)).otherwise(-w.link_conflict_penalty)
    strength = F.when(linked, "strong").otherwise("conflict")
    return signal("cross_link", "link", linked | (F.size(to_c) > 0) | (F.size(to_s) > 0), F.when(linked, 1.0).otherwise(0.0), points, strength, forward=forward, backward=backward)


def shared_socials(s: Column, c: Column, w: Scoring, owners: Column | None = None) -> Column:
    """The same account elsewhere on both profiles. owners: map of "kind:identity" to how many accounts hold it."""
    outside = lambda ids: F.filter(ids, lambda i: ~i["kind"].isin("twitch", "kick"))
    names = F.array(*[X.normalize_username(p[n]) for p in (s, c) for n in ("username", "display_name")])
    held = F.lit(None).cast("map<string,bigint>") if owners is None else owners
    parts = F.struct(outside(s["identities"]).alias("s"), outside(c["identities"]).alias("c"), names.alias("names"), held.alias("owners"))
    return X.let(X.let(parts, lambda p: _telling(p, w)), lambda p: _shared(p, w))


def _key(i: Column) -> Column:
    return F.concat(i["kind"], F.lit(":"), i["identity"])


def _telling(p: Column, w: Scoring) -> Column:
    """The shared identities, and those of them that tell who it is."""
    shared = F.filter(p["s"], lambda i: F.array_contains(F.transform(p["c"], _key), _key(i)))

    def tells(i: Column) -> Column:
        # both profiles of the pair hold a shared identity
        common = F.coalesce(F.try_element_at(p["owners"], _key(i)), F.lit(2)) - 2 >= w.generic_min_accounts
        return i["is_unique"] & ((i["kind"] != "website") | website_is_personal(i["identity"], p["names"])) & ~common

    return F.struct(p["s"].alias("s"), p["c"].alias("c"), F.size(shared).alias("n"), F.filter(shared, tells).alias("unique"))


def _shared(p: Column, w: Scoring) -> Column:
    n, weak = F.size(p["unique"]), p["n"] - F.size(p["unique"])
    kinds = lambda ids: F.transform(F.filter(ids, lambda i: ~i["kind"].isin("website", "discord")), lambda i: i["kind"])
    clash = F.arrays_overlap(kinds(p["s"]), kinds(p["c"]))
    score = F.when(n > 0, 1.0).when(weak > 0, 0.3).otherwise(0.0)
    points = F.when(n > 0, w.social_link_weight + w.social_additional_weight * F.least(F.lit(2), n - 1)).when(weak > 0, F.least(F.lit(4.0), 2.0 * weak)).when(clash, -3.0).otherwise(0.0)
    strength = F.when(n > 0, "strong").when(weak > 0, "weak").when(clash, "negative").otherwise("none")
    match = {f"{k}_match": F.array_contains(F.transform(p["unique"], lambda i: i["kind"]), k) for k in ("instagram", "youtube", "x", "tiktok")}
    listed = F.array_join(F.array_sort(F.transform(p["unique"], _key)), ",")
    return signal("shared_socials", "social", (F.size(p["s"]) > 0) & (F.size(p["c"]) > 0), score, points, strength, shared_unique=listed, **match)


def username(s: Column, c: Column, w: Scoring) -> Column:
    distinct = F.least(X.distinctiveness(X.normalize_username(s["username"])), X.distinctiveness(X.normalize_username(c["username"])))
    parts = F.struct(X.name_similarity(s["username"], c["username"]).alias("found"), distinct.alias("distinct"), (_present(s["username"]) & _present(c["username"])).alias("there"))
    return X.let(
        parts,
        lambda p: signal("username", "name", p["there"], p["found"]["score"], X.name_points(p["found"]["score"], w.username_weight, p["distinct"]), X.name_strength(p["found"]["score"]), method=p["found"]["method"], distinctiveness=p["distinct"]),
    )


def display_name(s: Column, c: Column, w: Scoring) -> Column:
    """The best of the name pairs besides login and login; worth less where display names restate the logins."""

    def compared(n: Column) -> Column:
        distinct = F.least(X.distinctiveness(X.normalize_username(n["a"])), X.distinctiveness(X.normalize_username(n["b"])))
        found = lambda f: F.when(f["score"] > 0, F.struct(f["score"].alias("score"), n["place"].alias("place"), f["method"].alias("method"), distinct.alias("distinct")))
        return X.let(X.name_similarity(n["a"], n["b"]), found)

    names = [(s["display_name"], c["display_name"]), (s["display_name"], c["username"]), (s["username"], c["display_name"])]
    best = F.array_max(F.array_compact(F.transform(F.array(*[F.struct(a.alias("a"), b.alias("b"), F.lit(-i).alias("place")) for i, (a, b) in enumerate(names)]), compared)))
    restated = (X.normalize_username(s["display_name"]) == X.normalize_username(s["username"])) & (X.normalize_username(c["display_name"]) == X.normalize_username(c["username"]))
    parts = F.struct(best.alias("best"), restated.alias("restated"), (_present(s["display_name"]) | _present(c["display_name"])).alias("there"))

    def told(p: Column) -> Column:
        score = F.coalesce(p["best"]["score"], F.lit(0.0))
        points = X.name_points(score, w.display_name_weight, F.coalesce(p["best"]["distinct"], F.lit(0.0))) * F.when(p["restated"], 0.3).otherwise(1.0)
        strength = F.when(p["restated"] & (X.name_strength(score) != "none"), "weak").otherwise(X.name_strength(score))
        return signal("display_name", "name", p["there"], score, points, strength, method=p["best"]["method"], redundant=p["restated"])

    return X.let(parts, told)


def all_text(p: Column) -> Column:
    return F.concat_ws("\n", F.when(p["description"] != "", p["description"]), F.when(p["extra_bio"] != "", p["extra_bio"]))


def bio_score(a: Column, b: Column, embedding: Column | None = None) -> Column:
    """struct(score, jaccard, cosine) of two token lists; embedding: cosine of their vectors, if there is one."""
    padded = lambda t: X.ngrams(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), 3)
    near = F.lit(None).cast("double") if embedding is None else embedding
    sets = F.struct(F.array_sort(F.array_distinct(a)).alias("a"), F.array_sort(F.array_distinct(b)).alias("b"), near.alias("near"))
    compared = X.let(sets, lambda p: F.struct(X.jaccard(p["a"], p["b"]).alias("jaccard"), X.cosine_of_counts(padded(p["a"]), padded(p["b"])).alias("cosine"), p["near"].alias("near")))

    def told(q: Column) -> Column:
        lexical = F.greatest(q["jaccard"], F.when(q["jaccard"] > 0.1, 0.9 * q["cosine"]).otherwise(0.6 * q["cosine"]))
        meaning = F.when(q["near"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (q["near"] - 0.55) / 0.4))).otherwise(0.0)
        return F.struct(F.greatest(lexical, meaning).alias("score"), q["jaccard"].alias("jaccard"), q["cosine"].alias("cosine"))

    return X.let(compared, told)


def bio(s: Column, c: Column, w: Scoring, embedding: Column | None = None) -> Column:
    """How alike two bios are. embedding: cosine of their vectors, where there are any."""
    a, b = X.bio_tokens(all_text(s)), X.bio_tokens(all_text(c))
    meaning = F.lit(None).cast("double") if embedding is None else embedding
    parts = F.struct(a.alias("a"), b.alias("b"), udfs.longest_common_run(a, b).alias("run"), meaning.alias("meaning"))
    scored = X.let(parts, lambda p: F.struct(bio_score(p["a"], p["b"], p["meaning"]).alias("found"), p["run"].alias("run"), ((F.size(p["a"]) >= 3) & (F.size(p["b"]) >= 3)).alias("there")))

    def told(p: Column) -> Column:
        found, run = p["found"], p["run"]
        plain = w.bio_weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (found["score"] - 0.3) / 0.5))
        points = F.when(run >= 10, F.greatest(plain, F.lit(w.bio_weight))).when(run >= 5, F.greatest(plain, F.lit(0.8 * w.bio_weight))).otherwise(plain)
        strength = F.when(run >= 10, "strong").when((run >= 5) | (found["score"] >= 0.5), "supporting").when(plain > 0, "weak").otherwise("none")
        return signal("bio", "text", p["there"], found["score"], points, strength, jaccard=found["jaccard"], cosine=found["cosine"], run=run)

    return X.let(scored, told)


def weighted_mean(parts: list[tuple[float, Column]]) -> Column:
    """Of the parts that are not null; null if all are."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(w * v, F.lit(0.0)) for w, v in parts), F.lit(0.0)), total)


def content(s: Column, c: Column, w: Scoring) -> Column:
    """Category, tags, language and title, as far as both sides have them."""
    joined = lambda p: F.split(X.fold(F.lower(F.array_join(F.coalesce(p["tags"], F.array().cast("array<string>")), "\u0001"))), "\u0001")
    named = lambda p: F.struct(F.coalesce(F.lower(X.strip(p["category"])), F.lit("")).alias("category"), X.normalize_language(p["language"]).alias("language"), joined(p).alias("tags"), F.array_distinct(X.bio_tokens(p["stream_title"])).alias("title"))
    return X.let(F.struct(named(s).alias("s"), named(c).alias("c")), lambda p: X.let(_content(p["s"], p["c"]), lambda q: _content_signal(q, w)))


def _content(s: Column, c: Column) -> Column:
    """struct(score, specific, language, tags): the weighted mean of the parts that both sides have."""
    generic = X.one_of(s["category"], config.GENERIC_CATEGORIES)
    same = s["category"] == c["category"]
    category = F.when((s["category"] != "") & (c["category"] != ""), F.when(same, F.when(generic, 0.3).otherwise(1.0)).otherwise(0.0))
    clean = lambda p: F.array_remove(F.array_remove(F.array_distinct(F.transform(p["tags"], lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))), ""), F.coalesce(p["language"], F.lit("")))
    ta, tb = clean(s), clean(c)
    tags = F.when((F.size(ta) > 0) & (F.size(tb) > 0), X.jaccard(ta, tb))
    language = F.when(s["language"].isNotNull() & c["language"].isNotNull(), F.when(s["language"] == c["language"], 1.0).otherwise(0.0))
    title = F.when((F.size(s["title"]) > 0) & (F.size(c["title"]) > 0), X.jaccard(s["title"], c["title"]))
    score = weighted_mean([(0.45, category), (0.25, tags), (0.2, language), (0.1, title)])
    return F.struct(score.alias("score"), (same & ~generic & (s["category"] != "")).alias("specific"), F.coalesce(language, F.lit(0.0)).alias("language"), F.coalesce(tags, F.lit(0.0)).alias("tags"))


def _content_signal(q: Column, w: Scoring) -> Column:
    supporting = q["specific"] & ((q["language"] == 1.0) | (q["tags"] >= 0.3))
    strength = F.when(supporting, "supporting").when(q["score"] > 0, "weak").otherwise("none")
    return signal("content", "content", q["score"].isNotNull(), q["score"], w.content_weight * q["score"], strength, category_specific_match=q["specific"], language_match=q["language"] == 1.0, tag_overlap=q["tags"])


def country_fit(country: Column, language: Column) -> Column:
    """1 if a language is spoken in a country, 0 if not, null where that can't be told."""
    return F.when(F.array_contains(X.country_languages(country), X.normalize_language(language)), 1.0).otherwise(
        F.when(X.country_languages(country).isNotNull() & X.normalize_language(language).isNotNull(), 0.0)
    )


def country(sheet: Column, c: Column, w: Scoring) -> Column:
    fit = F.when(_present(sheet), country_fit(sheet, c["language"]))
    return signal("country", "country", fit.isNotNull(), fit, w.country_weight * fit, F.when(fit > 0, "weak").otherwise("none"))


def variants_similarity(a: Column, b: Column) -> Column:
    """The best alignment of two pictures' variants (maps of hashes); outlines ("subject") are only compared with outlines."""
    entries = F.map_entries(a)
    best = F.transform(entries, lambda x: F.array_max(F.transform(F.map_entries(b), lambda y: F.when((x["key"] == "subject") == (y["key"] == "subject"), X.hash_similarity(x["value"], y["value"])).otherwise(0.0))))
    return F.greatest(F.array_max(best), F.lit(0.0))


def picture(similarity: Column, generic: Column, w: Scoring) -> Column:
    """From the similarity of two pictures, null if one isn't there, and whether one of them says nothing about its owner."""
    points = F.when(similarity >= w.image_similarity_threshold, w.image_weight).when(similarity >= w.image_moderate_threshold, 0.5 * w.image_weight).when(similarity < w.image_different_threshold, -w.image_different_penalty).otherwise(0.0)
    strength = F.when(similarity >= w.image_similarity_threshold, "strong").when(similarity >= w.image_moderate_threshold, "supporting").when(similarity < w.image_different_threshold, "negative").otherwise("none")
    points = F.when(generic, F.when(points > 0, points * w.generic_image_factor).otherwise(0.0)).otherwise(points)
    strength = F.when(generic, F.when(points > 0, "weak").otherwise("none")).otherwise(strength)
    return signal("profile_image", "image", similarity.isNotNull(), similarity, points, strength, generic=generic)
