"""Queries of catalogues as data sources: a platform that only a row of rules and a folder know, and profiles out of three lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import identities, platforms
from ..sources import accounts
from ..sources.tables import saved
from . import standins as S
from .catalogue import query


def rules(spark: SparkSession, *more: tuple) -> DataFrame:
    """The rules of the platforms in ``config``, and more rows."""
    own = [(name, r["hosts"], r["valid"], r["variant"], r["url"], r["written"], r["alike"], config.SEARCH_RESERVED_PATHS[name]) for name, r in config.HANDLE_RULES.items()]
    return spark.createDataFrame([*own, *more], accounts.RULES)


_PLAZA = ("plaza", ["plaza.example"], "^[a-z0-9.]{3,30}$", "^[a-z0-9.]{3,30}$", "https://plaza.example/", ["_- ", "..."], [".", ""], ["about"])


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'kick' WHEN o_orderkey % 11 = 1 THEN 'nowhere' ELSE 'plaza' END AS platform, o_orderkey % 6 AS k, o_custkey AS n FROM orders),
h AS (SELECT *, CASE WHEN platform = 'nowhere' THEN NULL WHEN k = 5 THEN 'user' || n WHEN platform = 'plaza' AND k < 3 THEN 'user.' || n END AS handle FROM c)
SELECT o_orderkey, platform, handle, CASE WHEN handle IS NOT NULL AND c_custkey % 3 > 0 AND platform = 'plaza' AND NOT (k = 5 AND c_custkey % 3 = 2) THEN c_name END AS display_name
FROM h JOIN customer ON c_custkey = n""")
def third_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's cell, looked up in a third platform's catalogue: a third of its accounts have a dot in their names, a third have none, and a third are not there."""
    n, k = F.col("c_custkey"), F.col("o_orderkey") % 6
    there = S.table(spark, sf_dir, "customer").filter(n % 3 > 0).select(F.concat(F.when(n % 3 == 2, "user.").otherwise("user"), n).alias("username"), F.col("c_name").alias("display_name"))
    folder = saved(there, "plaza").inputFiles()
    root = f"{folder[0].rsplit('/', 2)[0]}/catalogue-{uuid.uuid4().hex}"
    accounts.publish(there, root, buckets=16)
    cust = F.col("o_custkey")
    value = (
        F.when(k == 0, F.concat(F.lit(" @User."), cust)).when(k == 1, F.concat(F.lit("https://www.plaza.example/User."), cust, F.lit("/posts?x=1"))).when(k == 2, F.concat(F.lit("USER."), cust))
        .when(k == 3, F.concat(F.lit("https://other.example/user."), cust)).when(k == 4, F.lit(" ")).otherwise(F.concat(F.lit("user"), cust))
    )
    key = F.col("o_orderkey") % 11
    cells = S.table(spark, sf_dir, "orders").select("o_orderkey", F.when(key == 0, "kick").when(key == 1, "nowhere").otherwise("plaza").alias("platform"), value.alias("value"))
    out = platforms.found(cells, rules(spark, _PLAZA), {"plaza": accounts.Catalogue(spark, path=root)})
    return out.select("o_orderkey", "platform", "handle", F.col("profile.display_name").alias("display_name"))


@query("""WITH p AS (SELECT o_custkey AS n, max(o_orderkey) AS k FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS n, c_name, c_comment_ AS bio FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_comment_ FROM customer))
SELECT c.n, CASE WHEN c.n % 5 > 0 THEN s_name END AS display_name,
  CASE WHEN c.n % 5 > 0 AND s_suppkey IS NOT NULL AND c.n % 2 = 1 THEN 'https://p.example/' || c.n WHEN p.k IS NOT NULL THEN 'https://q.example/' || c.n END AS picture,
  CASE WHEN p.k IS NOT NULL THEN 'order ' || lpad(p.k::VARCHAR, 12, '0') ELSE bio END AS extra_bio,
  CASE WHEN p.k IS NULL THEN '' WHEN p.k % 2 = 0 THEN 'https://x.com/u' || c.n || ',https://tiktok.com/@t' || c.n ELSE 'https://i.example/' || c.n || ',https://x.com/u' || c.n || ',tik.tok' END AS links,
  CASE WHEN p.k IS NULL THEN 'api' ELSE 'api+public-profile' END AS source
FROM c LEFT JOIN supplier ON s_suppkey = c.n LEFT JOIN p ON p.n = c.n""")
def enriched_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as channels, suppliers as their users, the last of a customer's orders as the public page; pages come several times."""
    n = F.col("c_custkey")
    text = lambda name: F.lit(None).cast("string").alias(name)
    channels = S.table(spark, sf_dir, "customer").select(
        n.alias("n"), F.concat(F.lit("user"), n).alias("username"), F.when(n % 5 > 0, n.cast("string")).alias("user_id"), text("display_name"), text("profile_image_url"),
        F.when(n % 7 > 0, F.col("c_mktsegment")).alias("extra_bio"), F.lit(None).cast("array<string>").alias("extra_links"), F.lit("api").alias("source"),
    )
    u = F.col("s_suppkey")
    users = S.table(spark, sf_dir, "supplier").select(u.cast("string").alias("user_id"), F.col("s_name").alias("display_name"), F.when(u % 2 == 1, F.concat(F.lit("https://p.example/"), u)).otherwise("").alias("profile_image_url"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    even, odd = (("instagram", F.lit(" ")), ("twitter", F.concat(F.lit(" @u"), c)), ("tiktok", F.concat(F.lit("t"), c))), (("instagram", F.concat(F.lit("https://i.example/"), c)), ("twitter", F.concat(F.lit("u"), c)), ("tiktok", F.lit("tik.tok")))
    socials = [F.create_map(*[x for name, v in way for x in (F.lit(name), v)], F.lit("myspace"), F.lit("m")) for way in (even, odd)]
    public = S.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("user"), c).alias("username"), F.concat(F.lit("order "), F.lpad(k.cast("string"), 12, "0")).alias("bio"), F.concat(F.lit("https://q.example/"), c).alias("profile_image_url"),
        F.when(k % 2 == 0, socials[0]).otherwise(socials[1]).alias("socials"),
    )
    out = identities.profiles(channels, users, public)
    return out.select("n", "display_name", F.col("profile_image_url").alias("picture"), "extra_bio", F.array_join("extra_links", ",").alias("links"), "source")
