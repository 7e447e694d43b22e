"""Accounts, sheets and evidence derived from the driver's tables: each as a DataFrame and as the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ["Germany", "France", "Spain", "Italy", "Brazil", "Japan", "Canada"]
LANGUAGES = ["de", "fr", "es", "it", "pt", "ja", "en"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")"), index + 1)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts of the source platform: (source_key, country, category, language)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("user-"), F.col("c_custkey")).alias("source_key"), F.col("c_custkey").alias("n"), _pick(COUNTRIES, F.col("c_nationkey") % 7).alias("country"),
        F.lower("c_mktsegment").alias("category"), _pick(LANGUAGES, (F.col("c_custkey") % 7).cast("int")).alias("language"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as accounts of the target platform: (username, category, language); every third name is decorated."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("user_"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "_tv").otherwise(""))
    return s.select(
        name.alias("username"), F.lower(_pick(["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"], F.col("s_nationkey") % 5)).alias("category"),
        _pick(LANGUAGES, F.col("s_nationkey") % 7).alias("language"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SOURCES_SQL = f"""
sources AS (SELECT 'user-' || c_custkey AS source_key, c_custkey AS n, {_sql_list(COUNTRIES)}[(c_nationkey % 7 + 1)::INT] AS country, lower(c_mktsegment) AS category, {_sql_list(LANGUAGES)}[(c_custkey % 7 + 1)::INT] AS language FROM customer)"""
TARGETS_SQL = f"""
targets AS (SELECT 'user_' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '_tv' ELSE '' END AS username,
  lower(['MACHINERY', 'BUILDING', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD'][(s_nationkey % 5 + 1)::INT]) AS category, {_sql_list(LANGUAGES)}[(s_nationkey % 7 + 1)::INT] AS language FROM supplier)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheet rows with a stored outcome."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    platform = F.when(k % 2 == 0, "kick").otherwise("twitch")
    state = (k % 7).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), state + 1)
    return o.select(
        k.cast("int").alias("original_row"), F.concat(F.lit("user-"), F.col("o_custkey")).alias("source_key"), platform.alias("source_platform"),
        pick("EXISTS", "EXISTS", "EXISTS", "NOT_FOUND", "NOT_FOUND", "NOT_FOUND", "NOT_FOUND").alias("source_status"),
        pick("MATCH", "REVIEW", "NO_MATCH", "MATCH", "REVIEW", "NO_MATCH", "NO_MATCH").alias("decision"),
        pick(None, None, None, "VERIFIED", "EXISTS_UNVERIFIED", "EXISTS_UNVERIFIED", "NOT_FOUND").alias("target_status"),
        F.when(state.isin(0, 3), F.concat(F.lit("User_"), F.col("o_custkey"))).alias("matched_id"),
        F.when(k % 5 == 0, "None").when(k % 11 == 0, F.concat(F.lit("kept"), k)).alias("existing_destination"),
        F.when(k % 3 == 0, "no kick id").when(k % 13 == 0, "mine").when(k % 17 == 0, " n/a ").when(k % 19 == 0, "nearest possible channel").alias("existing_remarks"),
    )


ROWS_SQL = """
sheet AS (SELECT CAST(o_orderkey AS INT) AS original_row, 'user-' || o_custkey AS source_key, CASE WHEN o_orderkey % 2 = 0 THEN 'kick' ELSE 'twitch' END AS source_platform,
  CASE WHEN o_orderkey % 7 <= 2 THEN 'EXISTS' ELSE 'NOT_FOUND' END AS source_status,
  ['MATCH', 'REVIEW', 'NO_MATCH', 'MATCH', 'REVIEW', 'NO_MATCH', 'NO_MATCH'][(o_orderkey % 7 + 1)::INT] AS decision,
  [NULL, NULL, NULL, 'VERIFIED', 'EXISTS_UNVERIFIED', 'EXISTS_UNVERIFIED', 'NOT_FOUND'][(o_orderkey % 7 + 1)::INT] AS target_status,
  CASE WHEN o_orderkey % 7 IN (0, 3) THEN 'User_' || o_custkey END AS matched_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'None' WHEN o_orderkey % 11 = 0 THEN 'kept' || o_orderkey END AS existing_destination,
  CASE WHEN o_orderkey % 3 = 0 THEN 'no kick id' WHEN o_orderkey % 13 = 0 THEN 'mine' WHEN o_orderkey % 17 = 0 THEN ' n/a ' WHEN o_orderkey % 19 = 0 THEN 'nearest possible channel' END AS existing_remarks
  FROM orders)"""
STATUS = "CASE WHEN k % 23 = 0 THEN 'PENDING' WHEN k % 29 = 0 THEN 'TEMPORARY_ERROR' WHEN k % 31 = 0 THEN 'SKIPPED_EMPTY' WHEN k % 37 = 0 THEN 'PRESERVED' WHEN source_status = 'NOT_FOUND' AND decision <> 'MATCH' THEN 'SOURCE_NOT_FOUND' ELSE decision END"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows with a status and sometimes a verdict."""
    out = rows(spark, sf_dir).withColumn("k", F.col("original_row"))
    return out.withColumn("status", F.expr(STATUS)).withColumn("manual_verdict", F.when(F.col("k") % 41 == 0, "REJECTED")).drop("k")


OUTCOMES_SQL = f"""{ROWS_SQL},
outcomes AS (SELECT * EXCLUDE (k), {STATUS} AS status, CASE WHEN k % 41 = 0 THEN 'REJECTED' END AS manual_verdict FROM (SELECT *, original_row AS k FROM sheet))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as signals about a pair: (source_key, handle, ord, signals)."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), n + 1)
    family = pick((F.col("l_linenumber") % 7).cast("int"), "link", "social", "image", "name", "text", "content", "country")
    kind = pick((F.col("l_suppkey") % 6).cast("int"), "strong", "supporting", "weak", "none", "negative", "conflict")
    points = F.when(kind.isin("negative", "conflict"), -F.col("l_quantity") / 4).otherwise(F.col("l_quantity"))
    signal = F.struct(
        F.concat(family, F.lit("_"), F.col("l_linenumber")).alias("name"), family.alias("family"), (F.col("l_returnflag") != "R").alias("available"), F.col("l_discount").alias("score"),
        points.alias("points"), kind.alias("strength"), F.create_map().cast("map<string,string>").alias("data"),
    )
    lines = li.select("l_orderkey", signal.alias("signal")).groupBy("l_orderkey").agg(F.collect_list("signal").alias("signals"))
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(F.concat(F.lit("user-"), F.col("o_custkey")).alias("source_key"), F.col("o_orderkey").cast("string").alias("handle"), F.col("o_orderkey").alias("ord"), "signals")


EVIDENCE_SQL = """
ev AS (SELECT l_orderkey AS k, ['link', 'social', 'image', 'name', 'text', 'content', 'country'][(l_linenumber % 7 + 1)::INT] AS family,
  ['strong', 'supporting', 'weak', 'none', 'negative', 'conflict'][(l_suppkey % 6 + 1)::INT] AS strength,
  CASE WHEN l_suppkey % 6 IN (4, 5) THEN -l_quantity / 4 ELSE l_quantity END AS points FROM lineitem WHERE l_returnflag <> 'R'),
keys AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
pts AS (SELECT k, least(coalesce(sum(points) FILTER (family = 'name' AND points > 0), 0), 20.0) + coalesce(sum(points) FILTER (family = 'name' AND points < 0), 0) + coalesce(sum(points) FILTER (family <> 'name'), 0) AS points,
  count(DISTINCT family) FILTER (strength = 'strong') AS n_strong, coalesce(list_sort(list(DISTINCT family) FILTER (strength = 'strong')), []) AS strong,
  coalesce(list_sort(list(DISTINCT family) FILTER (strength IN ('strong', 'supporting') AND family <> 'country')), []) AS both_,
  coalesce(bool_or(strength = 'conflict'), false) AS conflict, coalesce(bool_or(strength = 'negative'), false) AS negative FROM keys LEFT JOIN ev USING (k) GROUP BY k),
gate AS (SELECT *, len(list_filter(both_, lambda f: NOT list_contains(strong, f))) AS n_supporting,
  CASE WHEN n_strong = 0 THEN least(CASE WHEN points <= 0 THEN 0.0 ELSE 100.0 * (1.0 - exp(-points / 16.0)) END, 89.0) WHEN points <= 0 THEN 0.0 ELSE 100.0 * (1.0 - exp(-points / 16.0)) END AS raw,
  negative AND NOT (list_contains(strong, 'link') OR list_contains(strong, 'social')) AS contradicted FROM pts),
gate2 AS (SELECT *, n_strong >= 2 OR (n_strong = 1 AND n_supporting >= 1) AS corroborated FROM gate),
scored AS (SELECT k, points, raw, n_strong, n_supporting, corroborated, conflict, contradicted,
  CASE WHEN conflict THEN CASE WHEN list_contains(strong, 'social') OR list_contains(strong, 'image') THEN 'REVIEW' ELSE 'NO_MATCH' END
    WHEN n_strong > 0 AND raw >= 90 AND corroborated AND NOT contradicted THEN 'MATCH' WHEN raw >= 70 OR n_strong > 0 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision FROM gate2),
final AS (SELECT *, CASE WHEN conflict OR (decision = 'REVIEW' AND contradicted) THEN least(raw, 89.0) ELSE raw END AS confidence FROM scored)"""


#: What becomes of the rows that ask for a customer, by its key mod 8 (see people).
KINDS = ["MATCH", "REVIEW", "MATCH", "MATCH", "REVIEW", "SOURCE_NOT_FOUND", "MATCH", "SKIPPED_EMPTY"]


def _name(prefix: str, key) -> F.Column:
    """Ten letters that depend on the key alone."""
    return F.translate(F.substring(F.md5(F.concat(F.lit(prefix), key.cast("string"))), 1, 10), "0123456789abcdef", "abcdefghiklmnopr")


def people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sheet, kick profiles, twitch profiles, pictures): orders ask for customers, whose accounts depend on c_custkey mod 8.

    0: one name, category, language and picture.  1: one name, all else apart.  2: letters swapped, one Instagram
    account and picture.  3: each account links the other.  4: one name and picture, but a link elsewhere.
    5: no account.  6: no kick account.  7: the cell is empty.  Suppliers and pages are further twitch accounts.
    """
    from .. import schemas

    fields = [f.split() for f in schemas.PROFILE.split(", ")]
    bits = F.expr("aggregate(embedding, 0L, (a, x) -> shiftleft(a, 1) | IF(x > 0, 1L, 0L))")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("bits"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n")).join(vectors, F.col("n") == F.col("vec_id"), "left")
    c = c.select("n", (F.col("n") % 8).alias("kind"), _name("c", F.col("n")).alias("base"), F.coalesce("bits", F.lit(0)).bitwiseXOR(F.xxhash64("n")).alias("hash"))
    kind, base = F.col("kind"), F.col("base")

    def by_kind(**given) -> F.Column:
        out = F.lit(None).cast("string")
        for k, v in given.items():
            out = F.when(kind == int(k[1:]), v if isinstance(v, F.Column) else F.lit(v)).otherwise(out)
        return out

    def profiles(df: DataFrame, platform: str, **columns) -> DataFrame:
        given = {"platform": F.lit(platform), **columns}
        return df.select(*[given.get(name, F.lit(None)).cast(t).alias(name) for name, t in fields])

    at = lambda side: F.concat(F.lit(f"https://pictures.example/{side}/"), F.col("n"))
    told = F.concat(F.lit("https://instagram.com/"), base)
    swapped = F.concat(F.substring("base", 1, 8), F.substring("base", 10, 1), F.substring("base", 9, 1), F.lit("_"))
    official = F.concat(base, F.lit("officialtv"))
    kick = profiles(
        c.filter("kind NOT IN (5, 6)"), "kick", username=F.when(kind == 3, F.concat(F.lit("the-real-"), base)).otherwise(base), profile_image_url=at("kick"),
        description=by_kind(k2=told, k3=F.concat(F.lit("twitch.tv/"), official), k4=F.concat(F.lit("https://twitch.tv/"), _name("other", F.col("n")))),
        category=by_kind(k0="Elden Ring", k1="Fortnite"), language=by_kind(k0="es", k1="fr"),
    )
    twitch = profiles(
        c.filter("kind <> 5"), "twitch", username=F.when(kind == 2, swapped).when(kind == 3, official).otherwise(base), profile_image_url=F.when(kind != 6, at("twitch")),
        description=by_kind(k2=told, k3=F.concat(F.lit("kick.com/the_real_"), base)), category=by_kind(k0="Elden Ring", k1="Minecraft"), language=by_kind(k0="es", k1="pt"),
    )
    supplied = profiles(table(spark, sf_dir, "supplier"), "twitch", username=_name("s", F.col("s_suppkey")), display_name=F.col("s_name"))
    paged = profiles(table(spark, sf_dir, "pages").select("page_id", "url").distinct(), "twitch", username=_name("p", F.col("page_id")), description=F.col("url"))
    pictures = [c.select(at(side).alias("url"), F.when(kind == 1, F.bitwise_not("hash")).otherwise(F.col("hash")).alias("h") if side == "twitch" else F.col("hash").alias("h")) for side in ("kick", "twitch")]
    h = F.col("h")
    images = pictures[0].unionByName(pictures[1]).select("url", F.sha2(h.cast("string"), 256).alias("sha256"), F.lit(False).alias("low_complexity"), F.create_map(F.lit("full"), F.struct(h.alias("p"), h.alias("d"), h.alias("a"))).alias("variants"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("original_row"), F.col("o_custkey").alias("n")).withColumn("kind", F.col("n") % 8).withColumn("base", _name("c", F.col("n")))
    value = F.when(kind == 3, F.concat(F.lit("the-real-"), base)).when(kind != 7, base)
    sheet = o.select("original_row", value.alias("source_value"), F.when(kind == 0, "Spain").when(kind == 2, "Germany").otherwise("France").alias("country"), F.lit(None).cast("string").alias("existing_destination"), F.lit(None).cast("string").alias("existing_remarks"))
    return sheet, kick, twitch.unionByName(supplied).unionByName(paged), images
