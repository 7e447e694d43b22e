"""Cases in which the engine once did less than the whole job."""

import numpy as np
from pyspark.sql import functions as F

from kinlink.functions.text import normalize_username
from kinlink.operators import blocking
from kinlink.plans import catalogue, standins


def bigrams(name):
    low = "".join(c for c in name.lower() if c.isalnum())
    return {low[i : i + 2] for i in range(len(low) - 1)} if len(low) >= 2 else {low}


def searched(sources, accounts, k, share=0.5):
    """Brute force: the k accounts of each source by shared bigrams and handle."""
    out = set()
    for s in sources:
        found = [(-len(bigrams(s) & bigrams(a)), a) for a in accounts if len(bigrams(s) & bigrams(a)) >= max(1, share * len(bigrams(a)))]
        out |= {(s, a, 1001 + i) for i, (_, a) in enumerate(sorted(found)[:k])}
    return out


def test_search_by_common_grams(spark):
    rng = np.random.default_rng(11)
    accounts = sorted({"".join(rng.choice(list("ab1"), int(rng.integers(3, 12)))) for _ in range(3000)} | {"a", "", "__", "A-B", "a_b", "zebra9"})
    sources = accounts[::60] + ["", "zebra", "ab", "q"]
    key = spark.createDataFrame([(s, s) for s in sources] + [(sources[0], sources[0])], "source_key string, username string")
    there = spark.createDataFrame([(a,) for a in [*accounts, accounts[5]]], "username string")
    for k, share in ((5, 0.5), (3, 0.8)):
        found = {(r.source_key, r.handle, r.ord) for r in blocking.search_by_grams(key, there, k, share).collect()}
        assert found == searched(set(sources), accounts, k, share)
    names = there.filter(F.length("username") > 3)
    # every name finds itself: no account shares more, and those that share as many come by handle
    full = blocking.search_by_grams(names.select(F.col("username").alias("source_key"), "username"), names, 1, 1.0)
    assert full.select("source_key").distinct().count() == names.distinct().count()


def test_search_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    found = {(r.source_key, r.handle, r.ord) for r in catalogue.QUERIES["search_blocking"](spark, d).collect()}
    low = lambda t: {r.username: r.low for r in catalogue._searched_names(spark, d, t).withColumn("low", normalize_username(F.col("username"))).collect()}
    grams = lambda names: {n: bigrams(x) for n, x in names.items()}
    asked, there = grams(low("benchmark")), grams(low("documents"))
    expected = set()
    for s, own in asked.items():
        near = sorted((-len(own & g), a) for a, g in there.items() if len(own & g) >= max(1, 0.5 * len(g)))
        expected |= {(s, a, 1001 + i) for i, (_, a) in enumerate(near[:5])}
    assert found == expected and len(asked) > 64


def test_resolve_sheet_on_planted_accounts(spark):
    d = "/root/testdata/sf0.001"
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 8).alias("kind")).collect()
    found = {r.original_row: (r.status, r.destination is not None) for r in catalogue.QUERIES["resolve_sheet"](spark, d).collect()}
    expected = {r.row: (standins.KINDS[r.kind], standins.KINDS[r.kind] == "MATCH") for r in asked}
    assert found == expected


def test_search_meets_few_pairs_that_share_too_little(spark):
    rng = np.random.default_rng(5)
    names = sorted({"".join(rng.choice(list("abcdefghiklmnopr"), 10)) for _ in range(4000)})
    there = spark.createDataFrame([(a,) for a in [*names, "thereal" + names[0]]], "username string")
    key = there.sample(0.5, 1).select(F.col("username").alias("source_key"), "username")
    met = []
    meeting = blocking._meeting
    try:
        blocking._meeting = lambda *given: met.append(meeting(*given)) or met[-1]
        found = {(r.source_key, r.handle, r.ord) for r in blocking.search_by_grams(key, there).collect()}
    finally:
        blocking._meeting = meeting
    asked = [r.source_key for r in key.collect()]
    assert found == searched(set(asked[:150]), [*names, "thereal" + names[0]], 10) | {x for x in found if x[0] not in asked[:150]}
    # joined by one rare bigram, a tenth of all pairs met
    assert met[0].count() < 0.04 * len(asked) * len(names)
    # several bigrams at once are each choice of them, once
    df = spark.createDataFrame([([3, 5, 8, 9], 1), ([3, 5, 8, 9], 2), ([3, 5, 8, 9, 11, 12], 5), ([3], 1)], "g array<short>, r int")
    codes = [r.c for r in df.select(blocking._subsets(F.col("g"), F.col("r")).alias("c")).collect()]
    assert codes[0] == [3, 5, 8, 9] and codes[3] == [3] and len(set(codes[2])) == 6
    assert sorted(codes[1]) == sorted(a * 2048 + b for a, b in ((3, 5), (3, 8), (3, 9), (5, 8), (5, 9), (8, 9)))
