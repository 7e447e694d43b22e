"""Catalogues as data sources: pushed filters, rules as rows, lookups of few and many handles, other stores, profiles from three lookups."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from kinlink.operators import identities, platforms
from kinlink.plans.platforms import _PLAZA, rules
from kinlink.sources import accounts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalogue") / "plaza")
    people = spark.range(500).select(F.concat(F.lit("u."), "id").alias("username"), "id", F.create_map(F.lit("a"), F.col("id")).alias("more"))
    none = spark.createDataFrame([(None, 9, None)], "username string, id long, more map<string,long>")
    accounts.publish(people.unionByName(none).unionByName(people.filter("id < 3")), path, buckets=8, parts=2)
    return path


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_store(spark, folder):
    there = accounts.Catalogue(spark, path=folder)
    whole = there.whole()
    assert whole.count() == 503 and whole.select("username").distinct().count() == 500
    few = there.of(["u.5", "u.77", "nobody", None, "u.5"])
    assert "PushedFilters: [In(username" in _plan(few) and sorted(r.id for r in few.collect()) == [5, 77]
    # a bucket's files at most
    one = there.of(["u.5"])
    assert one.rdd.getNumPartitions() <= 2 < whole.rdd.getNumPartitions() and [r.id for r in one.collect()] == [5]
    assert there.of([]).collect() == [] and there.of([None]).collect() == []
    # other filters on one DataFrame are Spark's, whatever was run before
    a, b = few.filter("username = 'u.5'"), few.filter("username = 'u.77' AND id > 5")
    assert [r.id for r in a.collect()] == [5] and [r.id for r in b.collect()] == [77] and few.count() == 2 and a.union(b).union(few).count() == 4
    c, d = whole.filter("username = 'u.5'"), whole.filter("username IN ('u.1', 'u.9')")
    assert (c.count(), d.count(), whole.count(), c.union(d).count(), c.join(d, "id", "full").count()) == (1, 3, 503, 4, 4)
    assert whole.filter("username IS NULL").collect() == [] and whole.filter("upper(username) = 'U.5'").count() == 1


def test_only_what_is_asked_is_read(spark, folder):
    """A store is asked for the files of the handles' buckets, and gives the row groups that may hold them."""
    store = accounts.Buckets({"path": folder})
    assert len(store.splits(None)) > 8 and {os.path.dirname(f)[-1] for f in store.splits(["u.5"])} == {str(accounts.bucket_of("u.5", 8))}
    assert sum(b.num_rows for f in store.splits(["u.5"]) for b in store.fetch(f, ["u.5"])) == 1 and store.splits([]) == []


def test_lookups_agree(spark, folder):
    there = accounts.Catalogue(spark, path=folder)
    keys = spark.createDataFrame([("u.1", 1), ("u.1", 2), ("no", 3), (None, 4), ("", 5), ("u.400", 6)], "handle string, n int")
    asked, joined = (sorted((r.n, r.profile and r.profile.id) for r in accounts.looked_up(keys, there, pushed=p).collect()) for p in (10, 2))
    assert asked == joined == [(1, 1), (2, 1), (3, None), (4, None), (5, None), (6, 400)]
    assert accounts.looked_up(keys.limit(0), there).collect() == []
    assert "PushedFilters: [In(username" not in _plan(accounts.looked_up(keys, there, pushed=2))


def test_empty_catalogue_and_clashes(spark, tmp_path):
    none = spark.createDataFrame([], "username string, id long")
    with pytest.raises(ValueError):
        accounts.publish(none.withColumn("bucket", F.lit(1)), str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exists"):
        os.makedirs(tmp_path / "y")
        accounts.publish(none, str(tmp_path / "y"))


class Numbers(accounts.Store):
    """Every even number is an account; whole reads are not possible."""

    def schema(self):
        return StructType().add("username", StringType()).add("id", LongType())

    def splits(self, handles):
        if handles is None:
            raise ValueError("ask for handles")
        return [handles[i : i + 2] for i in range(0, len(handles), 2)]

    def fetch(self, split, handles):
        own = [int(h) for h in split if h.isdigit() and int(h) % 2 == 0]
        yield pa.record_batch({"username": pa.array([str(i) for i in own]), "id": pa.array(own, pa.int64())})


def test_another_store(spark):
    there = accounts.Catalogue(spark, store=f"{__name__}:Numbers")
    keys = spark.createDataFrame([(str(i),) for i in range(9)], "handle string")
    assert {r.handle: r.profile and r.profile.id for r in accounts.looked_up(keys, there).collect()} == {str(i): None if i % 2 else i for i in range(9)}
    with pytest.raises(Exception, match="ask for handles"):
        there.whole().count()


def test_rules_are_rows(spark, folder):
    """A platform of no code: its addresses, names that mean the same, and reserved paths come from its row; the known ones read as before."""
    cells = [("plaza", "https://plaza.example/U.5/x"), ("plaza", " @u.5"), ("plaza", "u-5"), ("plaza", "https://kick.com/u.5"), ("plaza", None), ("kick", "https://kick.com/Foo-1"), ("twitch", "foo-1"), ("twitch", "Foo_1"), ("gone", "a"), (None, "a"), ("plaza", "u.5")]
    df = spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(cells)], "i int, platform string, value string")
    got = {r.i: (r.handle, r.profile and r.profile.id) for r in platforms.found(df, rules(spark, _PLAZA), {"plaza": accounts.Catalogue(spark, path=folder)}).collect()}
    assert got == {0: ("u.5", 5), 1: ("u.5", 5), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("foo-1", None), 6: (None, None), 7: ("foo_1", None), 8: (None, None), 9: (None, None), 10: ("u.5", 5)}
    from kinlink.functions import text as X

    ruled = platforms.with_handles(df.filter("platform = 'plaza'"), rules(spark, _PLAZA)).filter("i = 0")
    assert ruled.select(X.to_handle(F.lit("The U-5"), F.col("rules")), X.handle_from_url(F.lit("https://www.plaza.example/about"), F.col("rules")), X.handle_from_url(F.lit("https://plaza.example/U.5"), F.col("rules"))).first()[:] == ("the.u.5", None, "u.5")


def test_profiles_of_three_lookups(spark):
    schema = "username string, user_id string, display_name string, profile_image_url string, extra_bio string, extra_links array<string>, source string, own int"
    channels = spark.createDataFrame([("a", "1", None, None, "old", ["l"], "s", 1), ("b", None, None, None, None, None, "s", 2), ("a", "1", None, None, "old", ["l"], "s", 3), ("c", "3", None, None, "kept", None, "s", 4)], schema)
    users = spark.createDataFrame([("1", "A", ""), ("1", "B", ""), (None, "N", "x"), ("3", "", "pic")], "user_id string, display_name string, profile_image_url string")
    public = spark.createDataFrame([("a", "", "page", {"tiktok": "@t", "discord": " ", "other": "o", "youtube": "y.be/1"}), ("b", "bio", None, None), (None, "x", "x", None)], "username string, bio string, profile_image_url string, socials map<string,string>")
    got = {r.own: r for r in identities.profiles(channels, users, public).collect()}
    assert len(got) == 4 and got[1].asDict() | {"own": 3} == got[3].asDict()
    assert (got[1].display_name, got[1].profile_image_url, got[1].extra_bio, got[1].extra_links, got[1].source) == ("B", "page", None, ["l", "y.be/1", "https://tiktok.com/@t"], "s+public-profile")
    assert (got[2].display_name, got[2].extra_bio, got[2].extra_links) == (None, "bio", []) and (got[4].display_name, got[4].profile_image_url, got[4].extra_bio, got[4].source) == (None, "pic", "kept", "s")
    assert identities.profiles(channels.limit(0), users, public).collect() == [] and identities.profiles(channels, users.limit(0)).filter("display_name IS NOT NULL").count() == 0
