"""Candidate pairs by blocking keys: a source is only ever joined to accounts that share a key with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import existence_variants, let, name_similarity, name_variants, normalize_handle, normalize_username, to_handle
from ..sources.tables import saved


def existing(keys: DataFrame, catalogue: DataFrame, platform: str) -> DataFrame:
    """Each source key with the first account that it may mean; null where there is none. keys: (source_key, ...)."""
    asked = keys.select("source_key").distinct().select("source_key", F.posexplode(existence_variants(F.col("source_key"), platform)).alias("ord", "username"))
    found = asked.join(catalogue, "username").groupBy("source_key").agg(F.min_by(F.struct(*catalogue.columns), "ord").alias("profile"))
    return keys.join(found, "source_key", "left")


def probes(sources: DataFrame, platform: str) -> DataFrame:
    """(source_key, handle, via, ord): the handles under which a source may exist on ``platform``; sources are profiles with identities and source_key."""
    other_name = F.col("display_name").isNotNull() & (F.col("display_name") != "") & (normalize_username(F.col("display_name")) != normalize_username(F.col("username")))
    display = F.when(other_name, F.col("display_name"))
    linked = F.transform(F.filter("identities", lambda i: i["kind"] == platform), lambda i: i["identity"])

    def strategy(names: Column, via: str) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(via).alias("via")))

    named = F.concat(
        strategy(linked, "explicit_link"),
        strategy(F.array("username"), "exact_username"),
        strategy(name_variants(F.col("username")), "username_variant"),
        strategy(F.when(display.isNotNull(), F.array(display)), "display_name"),
        strategy(F.when(display.isNotNull(), name_variants(display)), "display_name_variant"),
    )
    out = sources.select("source_key", F.posexplode(named).alias("ord", "n"))
    return out.select("source_key", to_handle(F.col("n.name"), platform).alias("handle"), F.col("n.via").alias("via"), "ord").filter("handle IS NOT NULL")


def merged(*found: DataFrame) -> DataFrame:
    """Handles of several strategies as one row each, with all ways that led there. found: (source_key, handle, via, ord)."""
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("source_key", "handle").agg(F.array_sort(F.collect_set("via")).alias("via"), F.min("ord").alias("ord"))


def _subsets(grams: Column, r: Column) -> Column:
    """Each choice of r of a list's grams (numbers from 1 to under ``_BASE``, in order) as one number."""

    def chosen(prefix: Column) -> Column:
        level = F.transform(prefix, lambda g, i: F.struct(g.cast("long").alias("code"), i.alias("at")))
        out = F.when(r == 1, F.transform(level, lambda s: s["code"]))
        for size in range(2, _MOST_AT_ONCE + 1):
            more = lambda s: F.transform(F.slice(prefix, s["at"] + 2, F.size(prefix)), lambda g, i: F.struct((s["code"] * _BASE + g).alias("code"), (s["at"] + 1 + i).alias("at")))
            level = F.flatten(F.transform(level, more))
            out = out.when(r == size, F.transform(level, lambda s: s["code"]))
        return out

    return let(grams, chosen)


def _choices(n: Column, r: Column) -> Column:
    """In how many ways r of n can be chosen."""
    return F.aggregate(F.sequence(F.lit(1), r), F.lit(1.0), lambda c, i: c * (n - r + i) / i)


# the different bigrams of letters and digits, the single ones and the empty one fit below; five of them fit 64 bits
_BASE = 2048
_MOST_AT_ONCE = 5
# of one name
_MOST_CHOICES = 4096


def _meeting(left: DataFrame, right: DataFrame, common: DataFrame, share: float) -> DataFrame:
    """(asked, grams, need, r, code): the pairs of sets that may share enough, once for each r rarest grams that both hold. common: (gram, accounts, number)."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * F.col("n"))).cast("int")
    asking = left.groupBy(F.size("grams").alias("m")).agg(F.count("*").alias("asking"))
    lengths = right.groupBy(F.size("grams").alias("n")).agg(F.count("*").alias("accounts")).withColumn("need", need)
    # how many bigrams that are equally common would meet as often
    spread = common.agg((F.pow(F.sum(F.col("accounts").cast("double")), 2) / F.sum(F.pow(F.col("accounts").cast("double"), 2))).alias("spread"))
    # a row for each pair of lengths and each r: no more than names are long
    steps = asking.join(F.broadcast(lengths), F.col("need") <= F.col("m")).join(F.broadcast(spread)).withColumn("r", F.explode(F.sequence(F.lit(1), F.least(F.col("need"), F.lit(_MOST_AT_ONCE)))))
    steps = steps.withColumn("left", _choices(F.col("m") - F.col("need") + F.col("r"), F.col("r"))).withColumn("right", _choices(F.col("n") - F.col("need") + F.col("r"), F.col("r")))
    met = F.col("asking") * F.col("left") * F.col("accounts") * F.col("right") / F.greatest(F.lit(1.0), _choices(F.greatest(F.col("spread"), F.col("r")), F.col("r")))
    cost = F.when((F.col("r") == 1) | (F.greatest("left", "right") <= _MOST_CHOICES), F.col("asking") * F.col("left") + F.col("accounts") * F.col("right") + met)
    steps = saved(steps.groupBy("m", "n", "need").agg(F.min_by("r", cost).alias("r")), "steps")

    def chosen(size: str) -> Column:
        return F.explode(_subsets(F.slice("grams", F.lit(1), F.col(size) - F.col("need") + F.col("r")), F.col("r"))).alias("code")

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartition(tasks).withColumn("m", F.size("grams")).join(F.broadcast(steps), "m").select(F.col("grams").alias("asked"), "n", "need", "r", chosen("m"))
    right = right.repartition(tasks).withColumn("n", F.size("grams")).join(F.broadcast(steps.select("n", "need", "r").distinct()), "n").select("grams", "n", chosen("n"))
    return left.join(right, ["n", "code"])


def search_by_grams(sources: DataFrame, catalogue: DataFrame, k: int = 10, share: float = 0.5) -> DataFrame:
    """(source_key, handle, via, ord): the k accounts whose names share the most bigrams, ``share`` of the account's at least.

    Two names that share ``need`` bigrams have the r rarest of those in common, and these are among the
    n - need + r rarest of each.  So only names that hold the same r bigrams there are joined, for each number of
    bigrams apart; the pair is then counted in full.  The more at once, the fewer pairs and the more rows for each
    name: r is what costs least for the numbers of names there are.  Names are compared once for each set of
    bigrams: of accounts with the same set only the k first handles can be among a source's k.  Several names of one
    source_key are searched as one; repeated rows count once.
    """
    from ..functions.text import ngrams

    def grams(c: Column) -> Column:
        return F.array_distinct(ngrams(normalize_username(c), 2))

    def exploded(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(grams(F.col("username"))).alias("gram"))

    there = saved(exploded(catalogue.select(F.col("username").alias("handle"), "username"), "handle"), "there")
    # at most the pairs of 36 letters and digits, the single ones and the empty name: numbered, the rarest first
    counted = there.groupBy("gram").agg(F.count("*").alias("accounts"))
    common = saved(counted.withColumn("number", F.row_number().over(Window.orderBy("accounts", "gram")).cast("short")), "grams")

    def named(df: DataFrame, key: str) -> DataFrame:
        """(key, grams): the numbers of those bigrams that an account has, the rarest first."""
        return df.join(F.broadcast(common), "gram").groupBy(key).agg(F.array_sort(F.collect_set("number")).alias("grams"))

    asked = saved(named(exploded(sources, "source_key"), "source_key"), "asked")
    first = F.row_number().over(Window.partitionBy("grams").orderBy("handle"))
    known = saved(named(there, "handle").withColumn("first", first).filter(F.col("first") <= k), "known")
    both = _meeting(asked.select("grams").distinct(), known.filter("first = 1").select("grams"), common, share)
    both = both.withColumn("both", F.array_intersect("asked", "grams")).withColumn("shared", F.size("both")).filter("shared >= need")
    # a pair that meets several times counts where the rarest of its bigrams do
    rarest = F.aggregate(F.slice("both", F.lit(1), F.col("r")), F.lit(0).cast("long"), lambda code, g: code * _BASE + g)
    pairs = both.filter(rarest == F.col("code")).select("asked", "grams", "shared")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("shared"), "handle"))
    top = pairs.join(known.select("grams", "handle"), "grams").withColumn("ord", rank + 1000).filter(F.col("ord") <= k + 1000).select("asked", "handle", "ord")
    return asked.select("source_key", F.col("grams").alias("asked")).join(top, "asked").select("source_key", "handle", F.lit("platform_search").alias("via"), "ord")


def search_fallback(urls: DataFrame, platform: str, plausible: DataFrame, k: int = 10) -> DataFrame:
    """(source_key, handle, via, ord) from web results (source_key, rank, url), for sources without a plausible candidate."""
    from ..functions.text import handle_from_url

    found = urls.join(plausible.select("source_key").distinct(), "source_key", "left_anti").withColumn("handle", handle_from_url(F.col("url"), platform)).filter("handle IS NOT NULL")
    first = found.groupBy("source_key", "handle").agg(F.min("rank").alias("rank"))
    rank = F.row_number().over(Window.partitionBy("source_key").orderBy("rank", "handle"))
    return first.withColumn("ord", rank + 2000).filter(F.col("ord") <= k + 2000).select("source_key", "handle", F.lit("search_engine").alias("via"), "ord")


def candidates(sources: DataFrame, handles: DataFrame, catalogue: DataFrame, rejected: DataFrame | None = None, most: int = config.Scoring().max_candidates) -> DataFrame:
    """Sources with the accounts that exist under their handles, as columns s and c, with via.

    Rejected pairs (source_key, handle) are dropped.  Linked accounts always stay; of the others the ones
    with the most similar names, up to ``most`` in all.
    """
    if rejected is not None:
        handles = handles.join(rejected.select("source_key", "handle"), ["source_key", "handle"], "left_anti")
    pairs = handles.join(catalogue.select(F.col("username").alias("handle"), F.struct(*catalogue.columns).alias("c")), "handle")
    pairs = pairs.join(sources.select("source_key", F.struct(*sources.columns).alias("s")), "source_key")
    linked = F.array_contains("via", "explicit_link")
    names = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a in (F.col("s.username"), F.col("s.display_name")) for b in (F.col("handle"), F.col("c.display_name"))])
    alike = F.array_max(F.transform(names, lambda n: name_similarity(n["a"], n["b"])["score"]))
    ranked = pairs.withColumn("alike", alike).withColumn("linked", linked)
    rank = F.row_number().over(Window.partitionBy("source_key").orderBy(F.desc("linked"), F.desc("alike"), "ord", "handle"))
    return ranked.withColumn("rank", rank).filter(F.col("linked") | (F.col("rank") <= most))


def lookup_keys(rows: DataFrame, platform: str) -> DataFrame:
    """Adds source_key: the handle, or invalid:<text> where the cell can't be one; null for empty cells."""
    from ..functions.text import is_blank, strip

    handle = normalize_handle(F.col("source_value"), platform)
    return rows.withColumn("source_key", F.when(~is_blank(F.col("source_value")), F.coalesce(handle, F.concat(F.lit("invalid:"), F.lower(strip(F.col("source_value")))))))
