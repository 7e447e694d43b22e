"""All registered queries of the entity-resolution engine, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..config import Scoring
from ..functions import text as X
from ..functions.links import url_identity
from ..operators import blocking, decide, identities, overlap, rows, signals
from ..sources import cells as sheet
from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
W = Scoring()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# What the SQL expects, apart from the tables that the operators use.
_BLANK = "lower(trim(coalesce({}, ''))) IN ('', 'none', 'null', 'nan', 'n/a', 'na', '-', '--', 'unknown', 'not found')"
_LANGS = "MAP {'germany': ['de'], 'france': ['fr'], 'canada': ['en', 'fr'], 'spain': ['es'], 'italy': ['it'], 'brazil': ['pt'], 'japan': ['ja']}"
_OWN_REMARKS = "('no kick id', 'no twitch id found', 'no Id on both platforms', 'no kick channel found', 'no twitch channel found', 'nearest possible twitch channel', 'nearest possible kick channel', 'nearest possible channel')"
_OLD_REMARKS = "('nearest possible twitch channel', 'nearest possible kick channel', 'nearest possible channel')"
_FINAL = "('MATCH', 'NO_MATCH', 'REVIEW', 'SOURCE_NOT_FOUND', 'SKIPPED_EMPTY', 'PRESERVED')"
_STATE_ROWS = """
  ('kick', 'EXISTS', 'MATCH', NULL, 'KICK_A', true),
  ('kick', 'EXISTS', 'REVIEW', NULL, 'KICK_B', false),
  ('kick', 'EXISTS', 'NO_MATCH', NULL, 'KICK_B', false),
  ('kick', 'NOT_FOUND', 'MATCH', 'VERIFIED', 'KICK_C', true),
  ('kick', 'NOT_FOUND', 'REVIEW', 'EXISTS_UNVERIFIED', 'KICK_C2', false),
  ('kick', 'NOT_FOUND', 'NO_MATCH', 'EXISTS_UNVERIFIED', 'KICK_C2', false),
  ('kick', 'NOT_FOUND', 'NO_MATCH', 'NOT_FOUND', 'KICK_D', false),
  ('twitch', 'EXISTS', 'MATCH', NULL, 'TWITCH_A', true),
  ('twitch', 'EXISTS', 'REVIEW', NULL, 'TWITCH_B', false),
  ('twitch', 'EXISTS', 'NO_MATCH', NULL, 'TWITCH_B', false),
  ('twitch', 'NOT_FOUND', 'MATCH', 'VERIFIED', 'TWITCH_C1', true),
  ('twitch', 'NOT_FOUND', 'REVIEW', 'EXISTS_UNVERIFIED', 'TWITCH_C2', false),
  ('twitch', 'NOT_FOUND', 'NO_MATCH', 'EXISTS_UNVERIFIED', 'TWITCH_C2', false),
  ('twitch', 'NOT_FOUND', 'NO_MATCH', 'NOT_FOUND', 'TWITCH_C', false)"""

# --- sources, keys and lookups


def _cell() -> F.Column:
    return F.when(F.col("event_type") == "error", " N/A ").when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("event_type"))


@query(f"""WITH c AS (SELECT user_id % 10 AS bucket, CASE event_type WHEN 'error' THEN ' N/A ' WHEN 'view' THEN '' WHEN 'click' THEN NULL ELSE event_type END AS cell FROM events)
SELECT bucket, avg(CASE WHEN {_BLANK.format('cell')} THEN 0 ELSE 1 END) AS fill_rate, count(*) AS n FROM c GROUP BY bucket""")
def blank_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("bucket"), _cell().alias("cell"))
    return events.groupBy("bucket").agg(F.avg((~X.is_blank(F.col("cell"))).cast("int")).alias("fill_rate"), F.count("*").alias("n"))


@query("""SELECT c_custkey, 'user_' || c_custkey AS from_name,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'user' || c_custkey END AS handle,
  CASE WHEN length('u_' || c_custkey) BETWEEN 4 AND 25 THEN 'u_' || c_custkey END AS variant, 'a_' || c_custkey AS first_variant FROM customer""")
def handle_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" @USER"), k)).when(k % 4 == 1, F.concat(F.lit("https://www.twitch.tv/User"), k, F.lit("/about"))).when(k % 4 == 2, F.concat(F.lit("twitch.tv/user"), k)).otherwise(F.concat(F.lit("https://other.example/user"), k))
    return c.select(
        "c_custkey", X.to_handle(F.concat(F.lit("User-"), k), "twitch").alias("from_name"), X.normalize_handle(raw, "twitch").alias("handle"),
        X.to_handle(F.concat(F.lit("U."), k), "twitch").alias("variant"), X.existence_variants(F.concat(F.lit("a_"), k), "kick")[0].alias("first_variant"),
    )


@query("""SELECT c_custkey, c_name, s_name, n_name, s_name IS NOT NULL AS found FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def source_lookup_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = (S.table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    found = identities.enrich(c.withColumn("key", F.col("c_custkey")), s.withColumnRenamed("s_suppkey", "key"), "key")
    return found.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "s_name", "n_name", F.col("s_name").isNotNull().alias("found"))


@query(f"""WITH {S.SOURCES_SQL}, {S.TARGETS_SQL}, h AS (SELECT source_key, replace(source_key, '-', '_') AS handle, 'exact_username' AS via FROM sources
UNION ALL SELECT source_key, replace(source_key, '-', '_') || '_tv', 'username_variant' FROM sources UNION ALL SELECT source_key, replace(source_key, '-', '_'), 'username_variant' FROM sources)
SELECT source_key, handle, string_agg(DISTINCT via, ',' ORDER BY via) AS via FROM h JOIN targets ON username = handle GROUP BY ALL""")
def candidate_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("source_key", "handle", F.array_join("via", ",").alias("via"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and the targets that exist under one of their names."""
    s = S.sources(spark, sf_dir)
    name = F.col("source_key")
    found = [
        s.select("source_key", X.to_handle(v, "twitch").alias("handle"), F.lit(via).alias("via"), F.lit(i).alias("ord"))
        for i, (v, via) in enumerate([(name, "exact_username"), (F.concat(name, F.lit("_tv")), "username_variant"), (name, "username_variant")])
    ]
    targets = S.targets(spark, sf_dir).select(F.col("username").alias("handle"), F.struct(*S.targets(spark, sf_dir).columns).alias("c"))
    return blocking.merged(*found).join(targets, "handle").join(s.select("source_key", F.struct(F.col("source_key").alias("username"), *[c for c in s.columns if c != "source_key"]).alias("s")), "source_key")


@query("""SELECT 'user' || o_custkey AS source_key, lower(trim(o_orderpriority)) AS country_key, arg_min(o_totalprice, o_orderkey) AS first_price, min(o_orderkey) AS first_row, count(*) AS n_rows
FROM orders GROUP BY 1, 2""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select(F.concat(F.lit("user"), "o_custkey").alias("source_key"), F.col("o_orderpriority").alias("country"), F.col("o_totalprice").alias("source_value"), F.col("o_orderkey").alias("original_row"))
    first = o.groupBy("source_key", rows.country_key(F.col("country")).alias("country_key")).agg(F.min("original_row").alias("first_row"))
    return rows.groups(o).join(first, ["source_key", "country_key"]).select("source_key", "country_key", F.col("source_value").alias("first_price"), "first_row", "n_rows")


@query("""WITH r AS (SELECT 'user' || o_custkey AS source_key, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY 1)
SELECT o_orderkey AS original_row, 'user' || o_custkey AS source_key, n, best FROM orders JOIN r ON r.source_key = 'user' || o_custkey""")
def fanout_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("original_row"), F.concat(F.lit("user"), "o_custkey").alias("source_key"), F.lit("x").alias("country"), "o_totalprice")
    r = o.groupBy("source_key", F.lit("x").alias("country_key")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    return rows.fanned_out(o, r).select("original_row", "source_key", "n", "best")


# --- names


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different part names that share their first word."""
    p = S.table(spark, sf_dir, "part").select("p_name").distinct().withColumn("block", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return p.withColumnRenamed("p_name", "a").join(p.withColumnRenamed("p_name", "b"), "block").filter("a < b").select("a", "b")


_NAMES = "p AS (SELECT DISTINCT p_name FROM part), pairs AS (SELECT x.p_name AS a, y.p_name AS b FROM p x JOIN p y ON split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) AND x.p_name < y.p_name)"
_GRAMS = "list_distinct(list_transform(generate_series(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i::INT, 2)))"
_JACC = "len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1})))"


@query(f"WITH {_NAMES} SELECT a, b, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS similarity FROM pairs")
def name_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", X.levenshtein_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(f"WITH {_NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 9) AS similarity FROM pairs")
def name_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import udfs

    return _name_pairs(spark, sf_dir).select("a", "b", F.round(X.jaro_winkler(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"""WITH {_NAMES}, n AS (SELECT a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM pairs), g AS (SELECT *, {_GRAMS.format('x')} AS gx, {_GRAMS.format('y')} AS gy FROM n)
SELECT a, b, round(0.45 * (1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y))) + 0.40 * jaro_winkler_similarity(x, y) + 0.15 * {_JACC.format('gx', 'gy')}, 9) AS score, 'fuzzy' AS method FROM g""")
def name_similarity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.name_similarity(F.col("a"), F.col("b"))
    return _name_pairs(spark, sf_dir).withColumn("s", found).select("a", "b", F.round("s.score", 9).alias("score"), "s.method")


@query("""WITH n AS (SELECT c_custkey, 'user' || c_custkey AS name FROM customer), q AS (SELECT *, len(list_filter(generate_series(1, length(name)), lambda i: i = 1 OR substr(name, i::INT, 1) <> substr(name, (i - 1)::INT, 1))) AS squashed FROM n)
SELECT c_custkey, name, greatest(0.35, least(1.0, (squashed - 2) / 6.0 + 0.1)) AS distinctiveness FROM q""")
def distinctiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.normalize_username(F.concat(F.lit("USER_"), F.col("c_custkey")))
    return S.table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), X.distinctiveness(name).alias("distinctiveness"))


# The decorations of names, longest first, and what is put at their ends.
_VARIANTS = r"""WITH RECURSIVE n AS (SELECT DISTINCT p_name, lower(p_name) AS base, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS normal FROM part),
cut AS (SELECT p_name, normal AS core, 0 AS step FROM n UNION ALL SELECT p_name, CASE WHEN a IS NULL THEN core WHEN ends_with(core, a) THEN left(core, length(core) - length(a)) ELSE substr(core, length(a) + 1) END, step + 1
  FROM (SELECT *, list_filter(['offiziell', 'ufficiale', 'officiale', 'official', 'officiel', 'streamer', 'oficial', 'streams', 'channel', 'gaming', 'twitch', 'stream', 'gamer', 'games', 'clips', 'live', 'real', 'kick', 'ttv', 'the', 'its', 'itz', 'iam', 'tv', 'yt', 'gg'],
    lambda x: length(core) - length(x) >= 3 AND (ends_with(core, x) OR starts_with(core, x)))[1] AS a FROM cut) WHERE step < 20),
m AS (SELECT n.*, core, array_to_string(list_transform(list_filter(generate_series(1, length(normal)), lambda i: i = 1 OR substr(normal, i::INT, 1) <> substr(normal, i::INT - 1, 1)), lambda i: substr(normal, i::INT, 1)), '') AS squashed FROM n JOIN cut USING (p_name) WHERE step = 20),
c AS (SELECT *, list_filter(list_distinct([normal, core, CASE WHEN length(rtrim(normal, '0123456789')) >= 3 THEN rtrim(normal, '0123456789') ELSE normal END, CASE WHEN length(rtrim(core, '0123456789')) >= 3 THEN rtrim(core, '0123456789') ELSE core END, squashed]), lambda x: length(x) >= 3) AS cores FROM m),
g AS (SELECT p_name, list_concat([base, replace(base, ' ', ''), replace(base, ' ', '_'), replace(base, '-', '_'), replace(base, '_', '-'), replace(base, '.', '_'), translate(base, '-_. ', ''), trim(base, '_-')],
  flatten(list_transform(cores, lambda x: list_concat(list_transform(['', 'tv', 'ttv', 'live', 'yt', 'gaming', 'official', 'oficial', 'gg', '_tv', '_live', '_yt', '_gaming', '_official', '_oficial', '_ttv', '_', '__', '-tv', '-live', '-'], lambda e: x || e), list_transform(['the', 'its', 'real', 'iam', '_', 'the_', 'its_'], lambda p: p || x))))) AS v FROM c),
u AS (SELECT DISTINCT p_name, unnest(v) AS variant FROM g),
h AS (SELECT *, translate(lower(trim(variant)), '-. ', '__') AS t FROM u WHERE variant <> '')
SELECT p_name, variant, CASE WHEN regexp_matches(t, '^[a-z0-9][a-z0-9_]{3,24}$') THEN t END AS handle FROM h"""


@query(_VARIANTS)
def name_variants_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = S.table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", F.explode(X.name_variants(F.col("p_name"))).alias("variant")).select("p_name", "variant", X.to_handle(F.col("variant"), "twitch").alias("handle"))


# --- links

_HOST = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^(www|m|mobile|web)\\.(.*\\..*)$', '\\2')"


@query(f"""WITH h AS (SELECT page_id, lower({_HOST}) AS host, url FROM pages)
SELECT page_id, 'website' AS kind, host AS identity, NOT regexp_matches(lower(url), '[?&](ref|aff|affiliate|code|promo|utm_source)=[^&#]') AS is_unique FROM h""")
def url_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", url_identity(F.col("url")).alias("i")).select("page_id", "i.kind", "i.identity", "i.is_unique")


@query(f"""WITH h AS (SELECT page_id, lower({_HOST}) AS identity FROM pages) SELECT 'website' AS kind, identity, count(DISTINCT page_id) AS accounts FROM h GROUP BY identity""")
def identity_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages").select(F.lit("web").alias("platform"), F.col("page_id").cast("string").alias("username"), F.array(url_identity(F.col("url"))).alias("identities"))
    return identities.identity_owners(pages)


@query("""WITH c AS (SELECT DISTINCT conv_id, conv_id % 4 AS t FROM conversations), l AS (SELECT conv_id, t, 'kick-' || conv_id AS me, CASE t WHEN 0 THEN 'other' WHEN 1 THEN 'tw_' || conv_id ELSE NULL END AS to_c, CASE WHEN t = 2 THEN 'kick-' || conv_id WHEN t = 1 AND conv_id % 8 = 1 THEN 'kick-' || conv_id END AS to_s FROM c)
SELECT conv_id, coalesce(to_c, to_s) IS NOT NULL AS available, CASE WHEN t = 0 THEN 'conflict' WHEN t IN (1, 2) THEN 'strong' ELSE 'none' END AS strength,
  CASE WHEN t = 0 THEN -40.0 WHEN t = 1 AND conv_id % 8 = 1 THEN 35.0 WHEN t IN (1, 2) THEN 30.0 ELSE 0.0 END AS points FROM l""")
def cross_link_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    k, t = F.col("conv_id"), F.col("conv_id") % 4
    one = lambda kind, name: F.array(F.struct(F.lit(kind).alias("kind"), name.alias("identity")))
    none = F.array().cast("array<struct<kind:string,identity:string>>")
    s_ids = F.when(t == 0, one("twitch", F.lit("other"))).when(t == 1, one("twitch", F.concat(F.lit("tw_"), k))).otherwise(none)
    c_ids = F.when((t == 2) | (k % 8 == 1), one("kick", F.concat(F.lit("kick-"), k))).otherwise(none)
    pairs = c.select(
        "conv_id", F.struct(F.lit("kick").alias("platform"), F.concat(F.lit("Kick_"), k).alias("username"), s_ids.alias("identities")).alias("s"),
        F.struct(F.lit("twitch").alias("platform"), F.concat(F.lit("tw_"), k).alias("username"), c_ids.alias("identities")).alias("c"),
    )
    return pairs.select("conv_id", signals.cross_link(F.col("s"), F.col("c"), W).alias("x")).select("conv_id", "x.available", "x.strength", "x.points")


# --- texts and vectors


@query("""WITH d AS (SELECT doc_id, lang, n_chars, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents)
SELECT a.doc_id AS a_id, b.doc_id AS b_id, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) ELSE 0.0 END AS jaccard
FROM d a JOIN d b ON a.lang = b.lang AND a.n_chars = b.n_chars AND a.doc_id < b.doc_id""")
def bio_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language and length, by the words they share."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return overlap.jaccard_pairs(d, ["lang", "n_chars"], "n_chars")


@query("""WITH p AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, unnest(list_transform(generate_series(1, length(p_name)), lambda i: substr(' ' || p_name || ' ', i::INT, 3))) AS g FROM p),
c AS (SELECT p_name, g, count(*) AS n FROM g GROUP BY ALL), norm AS (SELECT p_name, sqrt(sum(n * n)) AS s FROM c GROUP BY ALL),
dots AS (SELECT x.p_name AS a, y.p_name AS b, sum(x.n * y.n) AS d FROM c x JOIN c y ON x.g = y.g AND x.p_name < y.p_name AND split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) GROUP BY ALL)
SELECT a, b, round(d / (na.s * nb.s), 9) AS cosine FROM dots JOIN norm na ON na.p_name = a JOIN norm nb ON nb.p_name = b""")
def bio_trigram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = lambda c: X.ngrams(F.concat(F.lit(" "), F.col(c), F.lit(" ")), 3)
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(X.cosine_of_counts(padded("a"), padded("b")), 9).alias("cosine"))


_STOP = "[" + ", ".join(f"'{w}'" for w in [*config.STOPWORDS, *config.BIO_BOILERPLATE]) + "]"
_URL_SQL = X._URL.replace("'", "''").replace('\\"', '"').replace("(?i)", "")


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '{_URL_SQL}', ' ', 'gi') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[@#][\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, lower(strip_accents(replace(replace(replace(t, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))) AS t FROM b)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))) AS n_tokens FROM c""")
def bio_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.size(X.bio_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT min(doc_id) AS first_doc, count(*) AS n FROM n WHERE t <> '' GROUP BY t HAVING count(*) > 1""")
def exact_bio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents").select("doc_id", X.strip(F.regexp_replace("text", r"\s+", " ")).alias("t")).filter("t <> ''")
    return d.groupBy("t").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").select("first_doc", "n")


def _next_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query("""SELECT x.vec_id, 1 - len(list_filter(generate_series(1, 64), lambda i: (x.embedding[i] > 0) <> (y.embedding[i] > 0)))::DOUBLE / 64 AS similarity FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""")
def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    hashes = lambda v: F.struct(bits(v).alias("p"), bits(v).alias("d"), bits(v).alias("a"))
    return _next_vectors(spark, sf_dir).select("vec_id", X.hash_similarity(hashes(F.col("a")), hashes(F.col("b"))).alias("similarity"))


@query("""SELECT x.vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)), 6) AS dot FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""")
def embedding_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return _next_vectors(spark, sf_dir).select("vec_id", F.round(dot, 6).alias("dot"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.3 END END AS a, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 10) / 10.0 END AS b, CASE WHEN o_custkey % 5 > 0 THEN 1.0 END AS c FROM orders)
SELECT o_orderkey, round((coalesce(0.45 * a, 0) + coalesce(0.25 * b, 0) + coalesce(0.2 * c, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.45 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END, 0), 9) AS score FROM p""")
def content_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, k = F.col("o_orderstatus"), F.col("o_custkey")
    parts = [(0.45, F.when(status != "P", F.when(status == "F", 1.0).otherwise(0.3))), (0.25, F.when(k % 3 > 0, (k % 10) / 10.0)), (0.2, F.when(k % 5 > 0, 1.0))]
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.round(signals.weighted_mean(parts), 9).alias("score"))


@query(f"""WITH {S.SOURCES_SQL} SELECT source_key, country, language, CASE WHEN list_contains({_LANGS}[lower(country)], language) THEN 1.0 ELSE 0.0 END AS fit FROM sources""")
def country_language_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sources(spark, sf_dir).select("source_key", "country", "language", signals.country_fit(F.col("country"), F.col("language")).alias("fit"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' ELSE 'es' END AS by_name, 'pt' AS by_tag, count(*) AS n FROM documents GROUP BY ALL")
def language_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "Français").when(F.col("lang") == "de", "Deutsch").otherwise("Español")
    d = S.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang", X.normalize_language(named).alias("by_name"), X.normalize_language(F.lit("pt-BR")).alias("by_tag"), "n")


# --- scores and decisions


@query(f"WITH {S.EVIDENCE_SQL} SELECT k AS ord, round(points, 6) AS points FROM pts")
def score_capped_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evidence(spark, sf_dir).select("ord", F.round(decide.points(F.col("signals"), W), 6).alias("points"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity - 10 <= 0 THEN 0.0 ELSE 100.0 * (1.0 - exp(-(l_quantity - 10) / 16.0)) END, 9) AS confidence FROM lineitem")
def confidence_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(decide.confidence(F.col("l_quantity") - 10, W), 9).alias("confidence"))


@query(f"WITH {S.EVIDENCE_SQL} SELECT k AS ord, decision, n_strong, corroborated, conflict, contradicted FROM final")
def decision_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.evaluated(S.evidence(spark, sf_dir), W).select("ord", "decision", F.size("strong").cast("long").alias("n_strong"), "corroborated", "conflict", "contradicted")


@query(f"""WITH {S.EVIDENCE_SQL}, f AS (SELECT 'user-' || o_custkey AS source_key, k, decision FROM final JOIN orders ON o_orderkey = k)
SELECT source_key, count(*) FILTER (decision = 'MATCH') AS n_matches, count(*) AS candidate_count, CASE WHEN count(*) FILTER (decision = 'MATCH') = 1 THEN 'MATCH' WHEN count(*) FILTER (decision IN ('MATCH', 'REVIEW')) > 0 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision FROM f GROUP BY source_key""")
def aggregate_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.aggregated(decide.evaluated(S.evidence(spark, sf_dir), W)).select("source_key", "n_matches", "candidate_count", "decision")


_RULED = f"""{S.SOURCES_SQL}, {S.TARGETS_SQL},
c AS (SELECT s.source_key, s.n, username AS handle, s.country, s.category AS ca, t.category AS cb, s.language AS la, t.language AS lb, replace(s.source_key, '-', '_') = username AS hit FROM sources s JOIN targets t ON username IN (replace(s.source_key, '-', '_'), replace(s.source_key, '-', '_') || '_tv')),
p AS (SELECT *, ca <> cb OR la <> lb OR NOT list_contains({_LANGS}[lower(country)], lb) AS problem, ca = cb AS near FROM c),
r AS (SELECT source_key, n, handle, CASE WHEN hit AND NOT problem THEN 'MATCH' WHEN hit OR near THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision FROM p)"""


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    none = F.array().cast(f"array<{signals.SIGNAL}>")
    hits = F.when(X.same_name(F.col("s.username"), F.col("c.username")), F.array(F.lit(config.RULES[0]))).otherwise(F.array().cast("array<string>"))
    pairs = pairs.withColumn("hits", hits).withColumn("problems", decide.contradictions(F.col("s"), F.col("c"), F.col("s.country"), none, F.col("hits")))
    near = F.when(F.col("s.category") == F.col("c.category"), "REVIEW").otherwise("NO_MATCH")
    pairs = pairs.withColumn("decision", near).withColumn("confidence", F.lit(0.0)).withColumn("place", F.col("ord")).withColumn("rejected", F.lit(False))
    return decide.ruled(pairs)


@query(f"WITH {_RULED} SELECT source_key, decision, CASE WHEN decision <> 'NO_MATCH' THEN handle END AS target FROM r")
def rule_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).select("source_key", "decision", "target")


_RESOLVED = f"""{_RULED}, a AS (SELECT s.source_key, s.n, coalesce(r.decision, 'NO_MATCH') AS decision, CASE WHEN r.decision = 'MATCH' THEN handle END AS matched_id FROM sources s LEFT JOIN r USING (source_key)),
e AS (SELECT *, CASE WHEN n % 10 = 0 THEN 'filled' WHEN n % 10 = 1 THEN 'None' END AS dest, CASE WHEN n % 6 = 0 THEN 'no twitch id found' WHEN n % 6 = 1 THEN 'mine' END AS rem FROM a)
SELECT CAST(n AS INT) + 2 AS original_row, source_key, CASE WHEN dest = 'filled' THEN 'PRESERVED' ELSE decision END AS status, decision,
  CASE WHEN dest = 'filled' THEN NULL ELSE matched_id END AS destination,
  CASE WHEN dest = 'filled' OR matched_id IS NOT NULL THEN NULL ELSE 'no twitch id found' END AS remarks,
  CASE WHEN dest = 'filled' THEN false ELSE matched_id IS NOT NULL OR dest IS NOT NULL END AS write_destination,
  CASE WHEN dest = 'filled' THEN false WHEN matched_id IS NULL THEN coalesce(rem, '') <> 'mine' ELSE coalesce(rem, '') = 'no twitch id found' END AS write_remarks,
  CASE WHEN decision = 'MATCH' THEN 'KICK_A' ELSE 'KICK_B' END || CASE WHEN dest = 'filled' THEN '_PRESERVED' ELSE '' END AS state_case FROM e"""


@query(f"WITH {_RESOLVED}")
def resolve_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source account, what its row writes by the final rules alone; resolve_sheet runs the whole engine."""
    n = F.col("n")
    asked = S.sources(spark, sf_dir).join(_ruled(spark, sf_dir), "source_key", "left").select(
        (n.cast("int") + 2).alias("original_row"), "source_key", F.lit("kick").alias("source_platform"), F.lit("EXISTS").alias("source_status"), F.coalesce("decision", F.lit("NO_MATCH")).alias("decision"),
        F.lit(None).cast("string").alias("target_status"), F.when(F.col("decision") == "MATCH", F.col("target")).alias("matched_id"),
        F.when(n % 10 == 0, "filled").when(n % 10 == 1, "None").alias("existing_destination"), F.when(n % 6 == 0, "no twitch id found").when(n % 6 == 1, "mine").alias("existing_remarks"),
    )
    return rows.transitions(asked).select("original_row", "source_key", "status", "decision", "destination", "remarks", "write_destination", "write_remarks", "state_case")


@query("""WITH d AS (SELECT doc_id, lang || '-' || source AS source_key, doc_id % 3 AS m FROM documents), v AS (SELECT d.*, CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 0 THEN 'CONFIRMED' END AS verdict FROM d LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, CASE WHEN verdict = 'CONFIRMED' THEN 3 WHEN verdict = 'REJECTED' THEN -1 WHEN m = 0 THEN 2 WHEN m = 1 THEN 1 ELSE 0 END AS state FROM v),
w AS (SELECT source_key, bool_or(verdict IS NOT NULL) AS touched, count(*) FILTER (state = 2) AS matches, max(state) AS top FROM s GROUP BY ALL)
SELECT source_key, CASE WHEN top = 3 THEN 'MATCH' WHEN top = 2 AND matches = 1 THEN 'MATCH' WHEN top > 0 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision,
  (SELECT min(doc_id) FROM s WHERE s.source_key = w.source_key AND s.state = w.top) AS target FROM w WHERE touched AND top > 0""")
def verdict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 3
    pairs = d.select(F.concat_ws("-", "lang", "source").alias("source_key"), F.col("doc_id").alias("handle"), F.when(m == 0, "MATCH").when(m == 1, "REVIEW").otherwise("NO_MATCH").alias("decision"), F.lit(50.0).alias("confidence"), F.lit(0).alias("place"))
    told = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 0, "CONFIRMED")
    verdicts = S.table(spark, sf_dir, "labels").join(d.select("doc_id", "lang", "source"), "doc_id").select(F.concat_ws("-", "lang", "source").alias("source_key"), F.col("doc_id").alias("target_key"), told.alias("verdict"), F.lit(0).alias("updated_at")).filter("verdict IS NOT NULL")
    return decide.reviewed(decide.overlaid(pairs, decide.latest_verdicts(verdicts))).filter("target IS NOT NULL").select("source_key", "decision", "target")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rejected_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, bad = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels").filter("toxic = 1")
    return d.join(bad, "doc_id", "left_anti").select("doc_id", "source")


# --- rows


_STATE = f"""{S.ROWS_SQL}, st AS (SELECT * FROM (VALUES {_STATE_ROWS}) AS t(p, ss, d, ts, base, w)),
j AS (SELECT sheet.*, base, w, coalesce(matched_id, '') <> '' AS has_id FROM sheet JOIN st ON p = source_platform AND ss = source_status AND d = decision AND ts IS NOT DISTINCT FROM CASE WHEN source_status = 'NOT_FOUND' THEN target_status END),
q AS (SELECT *, NOT ({_BLANK.format('existing_destination')}) AS kept, CASE WHEN w THEN matched_id END AS dest, {_BLANK.format('existing_remarks')} AS rblank, coalesce(trim(existing_remarks) IN {_OWN_REMARKS}, false) AS own, coalesce(trim(existing_remarks) IN {_OLD_REMARKS}, false) AS old,
  CASE WHEN source_status = 'EXISTS' AND has_id THEN NULL WHEN source_status = 'EXISTS' THEN CASE source_platform WHEN 'kick' THEN 'no twitch id found' ELSE 'no kick id' END WHEN has_id THEN 'no ' || source_platform || ' channel found' ELSE 'no Id on both platforms' END AS rem FROM j)
SELECT original_row, CASE WHEN kept THEN 'PRESERVED' WHEN source_status = 'NOT_FOUND' THEN CASE WHEN w THEN 'MATCH' ELSE 'SOURCE_NOT_FOUND' END ELSE decision END AS status, CASE WHEN NOT kept THEN dest END AS destination, CASE WHEN NOT kept THEN rem END AS remarks,
  CASE WHEN kept THEN false ELSE dest IS NOT NULL OR existing_destination IS NOT NULL END AS write_destination,
  CASE WHEN kept THEN old WHEN rem IS NOT NULL THEN rblank OR own ELSE own OR (existing_remarks IS NOT NULL AND rblank) END AS write_remarks, base || CASE WHEN kept THEN '_PRESERVED' ELSE '' END AS state_case FROM q"""


@query(f"WITH {_STATE}")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.transitions(S.rows(spark, sf_dir)).select("original_row", "status", "destination", "remarks", "write_destination", "write_remarks", "state_case")


_COUNTS = """count(*) AS total_rows, count(*) FILTER (status <> 'PENDING') AS processed_rows, count(*) FILTER (status = 'TEMPORARY_ERROR') AS error_count, count(*) FILTER (status IN ('SKIPPED_EMPTY', 'PRESERVED')) AS skipped_count,
count(*) FILTER (status = 'MATCH') AS match_count, count(*) FILTER (status IN ('REVIEW', 'NO_MATCH', 'SOURCE_NOT_FOUND') AND decision = 'REVIEW' AND manual_verdict IS NULL) AS review_count,
count(*) FILTER (status IN ('REVIEW', 'NO_MATCH', 'SOURCE_NOT_FOUND') AND NOT (decision = 'REVIEW' AND manual_verdict IS NULL)) AS no_match_count, count(*) FILTER (status = 'SOURCE_NOT_FOUND') AS not_found_count"""


@query(f"WITH {S.OUTCOMES_SQL} SELECT source_platform, {_COUNTS}, CASE WHEN count(*) FILTER (status = 'TEMPORARY_ERROR') > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS job_status FROM outcomes GROUP BY source_platform")
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.job_status(rows.counters(S.outcomes(spark, sf_dir), "source_platform"))


@query(f"WITH {S.OUTCOMES_SQL} SELECT original_row, status, decision, (SELECT count(*) FROM outcomes WHERE status = 'TEMPORARY_ERROR') AS total FROM outcomes WHERE status = 'TEMPORARY_ERROR' ORDER BY original_row LIMIT 20 OFFSET 10")
def row_grid_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the grid: its limit is the feature."""
    return rows.grid(S.outcomes(spark, sf_dir), status="ERROR", offset=10, limit=20).select("original_row", "status", "decision", "total")


@query(f"""WITH {S.OUTCOMES_SQL}, c AS (SELECT *, (original_row * 7) % 5 AS a FROM outcomes WHERE decision = 'REVIEW' AND status IN {_FINAL} AND manual_verdict IS NULL)
SELECT original_row, 'cand_' || (a + 1) AS candidate, len(list_filter(generate_series(0, 7), lambda i: i % 3 < 2))::BIGINT AS n_open, 5::BIGINT AS n_others FROM c""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.outcomes(spark, sf_dir)
    decision = lambda i: F.when(i % 3 == 0, "MATCH").when(i % 3 == 1, "REVIEW").otherwise("NO_MATCH")
    cands = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.concat(F.lit("cand_"), i).alias("username"), decision(i).alias("decision")))
    out = out.withColumn("candidates", cands).withColumn("review_candidate", F.concat(F.lit("cand_"), (F.col("original_row") * 7) % 5 + 1)).withColumn("matched_id", F.lit(None).cast("string"))
    found = rows.review_queue(out)
    return found.select("original_row", F.col("candidate.username").alias("candidate"), F.size(F.filter("candidates", lambda c: c["decision"] != "NO_MATCH")).cast("long").alias("n_open"), F.size("other_candidates").cast("long").alias("n_others"))


@query(f"WITH {S.OUTCOMES_SQL} SELECT original_row, CASE WHEN status = 'PENDING' THEN 'PENDING' WHEN status = 'TEMPORARY_ERROR' THEN 'ERROR' WHEN status IN ('SKIPPED_EMPTY', 'PRESERVED') THEN 'SKIPPED' WHEN status = 'MATCH' THEN 'MATCH' WHEN decision = 'REVIEW' AND manual_verdict IS NULL THEN 'REVIEW' WHEN status = 'SOURCE_NOT_FOUND' THEN 'NOT_FOUND' ELSE 'NO_MATCH' END AS shown, CASE WHEN status = 'TEMPORARY_ERROR' THEN 'PENDING' ELSE status END AS after_retry FROM outcomes")
def display_and_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.outcomes(spark, sf_dir)
    shown = out.withColumn("shown", rows.display_decision(F.col("status"), F.col("decision"), F.col("manual_verdict")))
    return rows.retry_failed(shown).select("original_row", "shown", F.col("status").alias("after_retry"))


@query(f"""WITH {S.OUTCOMES_SQL} SELECT original_row, CASE WHEN status NOT IN ('SKIPPED_EMPTY', 'PRESERVED') AND source_status = 'EXISTS' THEN CASE source_platform WHEN 'kick' THEN 'https://kick.com/' ELSE 'https://www.twitch.tv/' END || source_key END AS source_link,
CASE WHEN status NOT IN ('SKIPPED_EMPTY', 'PRESERVED') AND decision = 'MATCH' AND matched_id IS NOT NULL THEN CASE source_platform WHEN 'kick' THEN 'https://www.twitch.tv/' ELSE 'https://kick.com/' END || lower(matched_id) END AS target_link FROM outcomes""")
def channel_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.channel_links(S.outcomes(spark, sf_dir).withColumn("source_url", none).withColumn("target_url", none)).select("original_row", "source_link", "target_link")


@query("SELECT l_orderkey, l_partkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    return S.table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(by)).filter("place <= 3").select("l_orderkey", "l_partkey", "l_linenumber", F.col("place").cast("long").alias("place"))


# --- cells


def _cells(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """Suppliers as a sheet: name in column 1, balance in column 2; a changed copy differs in known places."""
    s = S.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    value = F.when(k % 7 == 3, "changed").when(k % 7 == 5, F.lit(None)).otherwise(F.col("s_name")) if changed else F.col("s_name")
    row = (k + 2).cast("int").alias("row")
    named = s.select(F.lit("Sheet").alias("sheet"), row, F.lit(1).alias("col"), value.alias("value"))
    return named.unionByName(s.select(F.lit("Sheet").alias("sheet"), row, F.lit(2).alias("col"), F.col("s_nationkey").cast("string").alias("value")))


@query("""SELECT CAST(s_suppkey + 2 AS INT) AS row, 1 AS col, CASE WHEN s_suppkey % 7 = 5 THEN s_name ELSE s_name END AS wanted, CASE WHEN s_suppkey % 7 = 3 THEN 'changed' END AS found FROM supplier WHERE s_suppkey % 7 = 5 OR (s_suppkey % 7 = 3 AND s_suppkey % 2 = 0)""")
def diff_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ and were not to be written; odd rows' changes were."""
    expected = S.table(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 3 AND s_suppkey % 2 = 1").select(F.lit("Sheet").alias("sheet"), (F.col("s_suppkey") + 2).cast("int").alias("row"), F.lit(1).alias("col"), F.lit("changed").alias("value"))
    return sheet.differences(_cells(spark, sf_dir), _cells(spark, sf_dir, True), expected).select("row", "col", "wanted", "found")


@query("SELECT CAST(s_suppkey + 2 AS INT) AS original_row, s_name AS source_value, CASE WHEN s_suppkey % 7 = 3 THEN 'changed' END AS found FROM supplier WHERE s_suppkey % 7 IN (3, 5)")
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _cells(spark, sf_dir).filter("col = 1").select("sheet", F.col("row").alias("original_row"), F.col("value").alias("source_value"))
    return sheet.moved_rows(kept, _cells(spark, sf_dir, True), 1).select("original_row", "source_value", "found")


@query("""SELECT CAST(c_custkey + 4 AS INT) AS original_row, 'user' || c_custkey AS source_value, CASE WHEN c_custkey % 3 = 0 THEN 'France' END AS country, CASE WHEN c_custkey % 5 = 0 THEN '12' END AS existing_destination FROM customer
WHERE c_custkey <= (SELECT max(c_custkey) FROM customer)""")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid out as a sheet whose header stands in row 3, found and read again."""
    c = S.table(spark, sf_dir, "customer")
    row = (F.col("c_custkey") + 4).cast("int").alias("row")
    cell = lambda col, value: c.select(F.lit("S").alias("sheet"), row, F.lit(col).alias("col"), value.alias("value"))
    head = c.agg(F.count("*")).select(F.lit("S").alias("sheet"), F.lit(3).alias("row"), F.posexplode(F.array(*map(F.lit, ["  ID_Kick ", "Pays", "id twitch", "Notes"])))).select("sheet", "row", (F.col("pos") + 1).alias("col"), F.col("col").alias("value"))
    cells = head.unionByName(cell(1, F.concat(F.lit("user"), "c_custkey"))).unionByName(cell(2, F.when(F.col("c_custkey") % 3 == 0, "France"))).unionByName(cell(3, F.when(F.col("c_custkey") % 5 == 0, "12.0")))
    cells = cells.filter("value IS NOT NULL")
    return sheet.rows(cells, sheet.header(cells), "kick").select("original_row", "source_value", "country", "existing_destination")


@query(f"""WITH {_STATE.replace('SELECT original_row, CASE WHEN kept', ', fin AS (SELECT original_row, CASE WHEN kept', 1)})
SELECT CAST(original_row + 2 AS INT) AS row, 3 AS col, destination AS value FROM fin WHERE write_destination UNION ALL SELECT CAST(original_row + 2 AS INT), 4, remarks FROM fin WHERE write_remarks""")
def expected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rows.transitions(S.rows(spark, sf_dir)).withColumn("original_row", F.col("original_row") + 2)
    return sheet.expected_cells(done, {"destination": 3, "remarks": 4}, "Sheet").select("row", "col", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k')::BIGINT % 3 + 1 AS n_candidates FROM events")
def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence documents: written as JSON, read again, and exploded to candidates."""
    e = S.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    doc = F.to_json(F.struct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("p.k") % 3), lambda i: F.struct(i.alias("rank"))).alias("candidates"), F.col("p.k").alias("k")))
    back = e.select("event_id", F.from_json(doc, "candidates array<struct<rank:bigint>>, k bigint").alias("d"))
    return back.select("event_id", "d.k", F.explode("d.candidates").alias("c")).groupBy("event_id", "k").agg(F.count("*").alias("n_candidates"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = S.table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "click", "PROCESSING").otherwise("QUEUED")).withColumn("updated_at", F.col("ts"))
    return rows.stale(jobs, F.to_timestamp(F.lit("2024-01-20 00:00:00")).cast(jobs.schema["ts"].dataType)).select("event_id", "user_id", "ts")


def _searched_names(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The different names of parts, and the first two words of the texts of ``table``."""
    two = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*(\S{1,20}\s+\S{1,20})", 1)
    parts, texts = S.table(spark, sf_dir, "part").select(F.col("p_name").alias("username")), S.table(spark, sf_dir, table).select(two.alias("username")).filter("username <> ''")
    return parts.unionByName(texts).distinct()


_SEARCHED = r"""WITH t AS (SELECT p_name AS u, true AS a, true AS b FROM part UNION ALL SELECT regexp_extract(coalesce(text, ''), '^\s*(\S{1,20}\s+\S{1,20})', 1), true, false FROM benchmark UNION ALL SELECT regexp_extract(coalesce(text, ''), '^\s*(\S{1,20}\s+\S{1,20})', 1), false, true FROM documents),
n AS (SELECT u, bool_or(a) AS a, bool_or(b) AS b, regexp_replace(lower(strip_accents(replace(replace(replace(u, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))), '[^0-9a-z]+', '', 'g') AS low FROM t WHERE u <> '' GROUP BY u),
g AS (SELECT u, a, b, CASE WHEN length(low) < 2 THEN [low] ELSE list_distinct(list_transform(generate_series(1, length(low) - 1), lambda i: substr(low, i::INT, 2))) END AS g FROM n),
p AS (SELECT x.u AS source_key, y.u AS handle, len(list_intersect(x.g, y.g)) AS shared, len(y.g) AS size FROM g x JOIN g y ON x.a AND y.b)
SELECT source_key, handle, ord FROM (SELECT *, 1000 + row_number() OVER (PARTITION BY source_key ORDER BY shared DESC, handle) AS ord FROM p WHERE shared >= greatest(1, ceil(0.5 * size))) WHERE ord <= 1005"""


@query(_SEARCHED)
def search_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For names of parts and benchmark items, the names of parts and documents that share the most bigrams."""
    asked = _searched_names(spark, sf_dir, "benchmark").select(F.col("username").alias("source_key"), "username")
    return blocking.search_by_grams(asked, _searched_names(spark, sf_dir, "documents"), k=5).select("source_key", "handle", F.col("ord").cast("long").alias("ord"))


# --- the whole engine


@query("""WITH o AS (SELECT CAST(o_orderkey AS INT) AS original_row, o_custkey % 8 AS kind, translate(substr(md5('c' || o_custkey), 1, 10), '0123456789abcdef', 'abcdefghiklmnopr') AS base FROM orders)
SELECT original_row, CASE WHEN kind = 3 THEN 'the-real-' || base WHEN kind <> 7 THEN base END AS source_key, CASE WHEN kind IN (5, 6) THEN 'NOT_FOUND' WHEN kind <> 7 THEN 'EXISTS' END AS source_status,
  CASE kind WHEN 1 THEN 'REVIEW' WHEN 4 THEN 'REVIEW' WHEN 5 THEN 'SOURCE_NOT_FOUND' WHEN 7 THEN 'SKIPPED_EMPTY' ELSE 'MATCH' END AS status, CASE kind WHEN 1 THEN 'REVIEW' WHEN 4 THEN 'REVIEW' WHEN 5 THEN 'NO_MATCH' WHEN 7 THEN NULL ELSE 'MATCH' END AS decision,
  CASE kind WHEN 0 THEN base WHEN 2 THEN substr(base, 1, 8) || substr(base, 10, 1) || substr(base, 9, 1) || '_' WHEN 3 THEN base || 'officialtv' WHEN 6 THEN base END AS destination,
  CASE kind WHEN 1 THEN 'no twitch id found' WHEN 4 THEN 'no twitch id found' WHEN 5 THEN 'no Id on both platforms' WHEN 6 THEN 'no kick channel found' END AS remarks, CASE WHEN kind IN (1, 4) THEN base END AS review_candidate,
  CASE WHEN kind < 5 THEN kind IN (0, 2, 3) END AS sure, kind IN (0, 2, 3, 6) AS write_destination, kind IN (1, 4, 5, 6) AS write_remarks,
  CASE kind WHEN 1 THEN 'KICK_B' WHEN 4 THEN 'KICK_B' WHEN 5 THEN 'KICK_D' WHEN 6 THEN 'KICK_C' WHEN 7 THEN 'EMPTY_SOURCE' ELSE 'KICK_A' END AS state_case FROM o""")
def resolve_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a row of a sheet, resolved by names, links, pictures, evidence, gates and rules; sure: the confidence that a match needs is reached."""
    from .resolve import resolve

    sheet_rows, kick, twitch, images = S.people(spark, sf_dir)
    searched = blocking.search_by_grams(kick.select(F.col("username").alias("source_key"), "username"), twitch)
    out = resolve(sheet_rows, kick, twitch, "kick", images, searched=searched)
    return out.select("original_row", "source_key", "source_status", "status", "decision", "destination", "remarks", "review_candidate", (F.col("confidence") >= 90).alias("sure"), "write_destination", "write_remarks", "state_case")


# --- pictures, missing sources, resumed runs


@query("""WITH s AS (SELECT x.vec_id, 1 - len(list_filter(generate_series(1, 64), lambda i: (x.embedding[i] > 0) <> (y.embedding[i] > 0)))::DOUBLE / 64 AS sim, x.vec_id % 4 = 0 AS generic FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
p AS (SELECT *, CASE WHEN sim >= 0.9 THEN 20.0 WHEN sim >= 0.8 THEN 10.0 WHEN sim < 0.62 THEN -6.0 ELSE 0.0 END AS pts, CASE WHEN sim >= 0.9 THEN 'strong' WHEN sim >= 0.8 THEN 'supporting' WHEN sim < 0.62 THEN 'negative' ELSE 'none' END AS st FROM s)
SELECT vec_id, round(CASE WHEN generic THEN CASE WHEN pts > 0 THEN pts * 0.15 ELSE 0.0 END ELSE pts END, 9) AS points, CASE WHEN generic THEN CASE WHEN pts > 0 THEN 'weak' ELSE 'none' END ELSE st END AS strength FROM p""")
def picture_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = hash_distance(spark, sf_dir)
    found = similar.select("vec_id", signals.picture(F.col("similarity"), F.col("vec_id") % 4 == 0, W).alias("p"))
    return found.select("vec_id", F.round("p.points", 9).alias("points"), "p.strength")


@query("SELECT label AS hash, count(DISTINCT vec_id % 10) AS names FROM embeddings GROUP BY label")
def hash_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("Chan-nel "), F.col("vec_id") % 10).alias("username"), F.col("label").alias("hash"))
    return identities.hash_owners(e)


@query(f"""WITH {_RULED}, m AS (SELECT s.source_key, c.handle, NOT list_contains({_LANGS}[lower(s.country)], c.lb) AS off FROM sources s LEFT JOIN c ON c.source_key = s.source_key AND c.hit)
SELECT source_key, CASE WHEN handle IS NULL THEN 'NO_MATCH' WHEN off THEN 'REVIEW' ELSE 'MATCH' END AS decision, CASE WHEN handle IS NULL THEN 'NOT_FOUND' WHEN off THEN 'EXISTS_UNVERIFIED' ELSE 'VERIFIED' END AS target_status FROM m""")
def source_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as if its account were gone: a same-name account decides, unless its language doesn't fit the country."""
    from .resolve import missing_candidates

    none = F.array().cast("array<struct<kind:string,identity:string,url:string,is_unique:boolean,via:string>>")
    asked = S.sources(spark, sf_dir).select("source_key", F.col("source_key").alias("key"), "country")
    found = missing_candidates(asked, S.targets(spark, sf_dir).withColumn("identities", none), "kick").withColumn("rejected", F.lit(False))
    out = asked.join(decide.ruled_missing(found), "source_key", "left")
    return out.select("source_key", F.coalesce("decision", F.lit("NO_MATCH")).alias("decision"), F.coalesce("target_status", F.lit("NOT_FOUND")).alias("target_status"))


@query(f"WITH {S.OUTCOMES_SQL} SELECT original_row, source_key FROM outcomes WHERE status = 'PENDING'")
def resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.unfinished(S.outcomes(spark, sf_dir)).select("original_row", "source_key")


@query(f"""WITH {S.OUTCOMES_SQL}, v AS (SELECT DISTINCT 'user-' || user_id AS source_key FROM events WHERE event_type = 'error')
SELECT original_row FROM outcomes WHERE status NOT IN ('PRESERVED', 'SKIPPED_EMPTY') AND source_key IN (SELECT source_key FROM v)""")
def verdict_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = S.table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.concat(F.lit("user-"), "user_id").alias("source_key"))
    return rows.verdict_fanout(S.outcomes(spark, sf_dir), verdicts).select("original_row")


@query(f"""WITH {S.EVIDENCE_SQL} SELECT k AS ord, count(*) FILTER (strength = 'strong') > 0 OR any_value(points_all) >= 3.0 AS promising FROM (SELECT pts.k, ev.strength, pts.points AS points_all FROM pts LEFT JOIN ev USING (k)) GROUP BY k""")
def promising_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evidence(spark, sf_dir).select("ord", decide.promising(F.col("signals"), W).alias("promising"))
