"""Queries that run an operator over whole tables on chosen cases, with what each case must give written out in SQL.

A row takes the case of its key, and ``{k}`` in a case stands for the key.  The expected values are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions import text as X
from ..functions.links import IDENTITY, extract_identities, url_identity, website_is_personal
from ..operators import blocking, decide, report, rows, signals
from ..sources import cells as sheet
from . import standins as S
from .catalogue import ORACLES, QUERIES, query

W = Scoring()


class Sql(str):
    """An expected value as an SQL expression."""


def _literal(value, key: str) -> str:
    if isinstance(value, Sql):
        return str(value)
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        text = "'" + value.replace("'", "''") + "'"
        return f"replace({text}, '{{k}}', {key}::VARCHAR)" if "{k}" in value else text
    return f"{value!r}::DOUBLE" if isinstance(value, float) else f"{value}::BIGINT"


def golden(name: str, table: str, key: str, inputs: str, given: list[tuple], outputs: dict[str, Callable[[DataFrame], Column]]) -> None:
    """Registers a query: given holds (input values, expected values); outputs computes each named output from the input columns."""
    n, names = len(given), inputs.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = S.table(spark, sf_dir, table)
        at = (F.pmod(F.col(key), F.lit(n)) + 1).cast("int")
        pick = lambda i: F.replace(F.element_at(F.array(*[F.lit(case[0][i]).cast("string") for case in given]), at), F.lit("{k}"), F.col(key).cast("string"))
        df = t.select(F.col(key).alias("k"), *[pick(i).alias(c) for i, c in enumerate(names)])
        return df.select("k", *[f(df).alias(c) for c, f in outputs.items()])

    run.__name__ = name
    chosen = ", ".join("CASE k % {} {} END AS {}".format(n, " ".join(f"WHEN {i} THEN {_literal(case[1][j], 'k')}" for i, case in enumerate(given)), c) for j, c in enumerate(outputs))
    QUERIES[name], ORACLES[name] = run, f"SELECT k, {chosen} FROM (SELECT {key} AS k FROM {table})"


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 9)


# --- names

golden(
    "name_normal_forms", "customer", "c_custkey", "name",
    [
        (("Müller_TV",), ("mullertv", "mulertv", "muller", "mullertv", "muller tv", "müller_tv")),
        (("OfficialJoséPeña99",), ("officialjosepena99", "oficialjosepena9", "josepena99", "officialjosepena", "official jose pena99", "officialjosépeña99")),
        (("xX__gamer__Xx7",), ("xxgamerxx7", "xgamerx7", "xxgamerxx7", "xxgamerxx", "x x gamer xx7", "xx__gamer__xx7")),
        ((" theRealTV ",), ("therealtv", "therealtv", "real", "therealtv", "the real tv", "therealtv")),
        (("Straße x",), ("strassex", "strasex", "strassex", "strassex", "strasse x", "strasse x")),
        (("",), ("", "", "", "", "", "")),
        ((None,), ("", "", "", "", "", None)),
        (("Ｆｕｌｌ ﬁne",), ("fullfine", "fulfine", "fullfine", "fullfine", "full fine", "full ﬁne")),
    ],
    {
        "normal": lambda d: X.normalize_username(d["name"]), "squashed": lambda d: X.squash_repeats(X.normalize_username(d["name"])), "core": lambda d: X.without_affixes(X.normalize_username(d["name"]))["core"],
        "no_digits": lambda d: X.strip_trailing_digits(X.normalize_username(d["name"])), "tokens": lambda d: F.array_join(X.tokenize_name(d["name"]), " "), "folded_case": lambda d: X.casefold(d["name"]),
    },
)


def _fuzzy_sql(a: str, b: str) -> str:
    grams = "list_distinct(list_transform(generate_series(1, greatest(length('{0}') - 1, 1)), lambda i: substr('{0}', i::INT, 2)))"
    x, y = grams.format(a), grams.format(b)
    return f"0.45 * (1 - levenshtein('{a}', '{b}')::DOUBLE / greatest(length('{a}'), length('{b}'))) + 0.40 * jaro_winkler_similarity('{a}', '{b}') + 0.15 * len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y})))"


def _points_sql(score: str, weight: float) -> Sql:
    return Sql(f"round(CASE WHEN {score} < 0.7 THEN 0.0 ELSE {weight} * least(1.0, ({score} - 0.7) / 0.27) END, 9)")


def _named(a: str | None, b: str | None, score: str, method: str) -> tuple:
    return (a, b), (Sql(f"round({score}, 9)"), method, _points_sql(f"({score})", 15.0), Sql(f"CASE WHEN {score} < 0.7 THEN 'none' WHEN {score} >= 0.8 THEN 'supporting' ELSE 'weak' END"))


golden(
    "name_similarity_branches", "customer", "c_custkey", "a b",
    [
        _named("Star{k}", "STAR{k}", "1.0", "exact"), _named("Mr. Beast{k}", "mr_beast{k}", "0.97", "equal_after_normalisation"),
        _named("x", "", "0.0", "missing"), _named(None, "x", "0.0", "missing"), _named("!!", "x", "0.0", "empty_after_normalisation"),
        _named("jimmyboyyyq", "jimmyboyq", "0.93", "equal_ignoring_repeated_letters"), _named("marcopolo", "marcopololive", "0.86", "equal_after_affix_removal"),
        _named("bobinice12345", "bobinice9", "0.84", "equal_ignoring_trailing_digits"), _named("nikkilve", "NikkLive_", _fuzzy_sql("nikkilve", "nikklive"), "fuzzy"),
        _named("officialzubenko", "zubenka", f"0.92 * ({_fuzzy_sql('zubenko', 'zubenka')})", "fuzzy_after_affix_removal"), _named("xqc", "pokimane", _fuzzy_sql("xqc", "pokimane"), "fuzzy"),
        _named("ÉCLAIRÉ{k}", "éclairé{k}", "1.0", "exact"), _named("eclairez{k}", "Éclairez{k}", "0.97", "equal_after_normalisation"),
    ],
    {
        "score": lambda d: rounded(X.name_similarity(d["a"], d["b"])["score"]), "method": lambda d: X.name_similarity(d["a"], d["b"])["method"],
        "points": lambda d: rounded(X.name_points(X.name_similarity(d["a"], d["b"])["score"], 15.0, F.lit(1.0))), "strength": lambda d: X.name_strength(X.name_similarity(d["a"], d["b"])["score"]),
    },
)

golden(
    "account_handles", "customer", "c_custkey", "platform name shown",
    [
        (("twitch", "user{k}", "User{k}"), ("User{k}", "user-{k}", "user{k}", "user{k}")), (("kick", "a_{k}", "A_{k}"), ("a_{k}", "a-{k}", "a_{k},a-{k}", "a-{k}")),
        (("twitch", "user{k}", "Other"), ("user{k}", "user-{k}", "user{k}", "user{k}")), (("kick", "@B_{k}", None), ("@B_{k}", None, "@B_{k},@B-{k}", "b-{k}")),
        (("kick", "n.m {k}", ""), ("n.m {k}", "n-m{k}", "n.m {k}", "n.m {k}")),
    ],
    {
        "display_id": lambda d: X.display_id(d["platform"], d["name"], d["shown"]), "as_kick": lambda d: X.to_handle(F.when(d["platform"] == "twitch", F.replace(d["name"], F.lit("user"), F.lit("USER_"))).otherwise(d["name"]), "kick"),
        "same_account": lambda d: F.when(d["platform"] == "kick", F.array_join(X.existence_variants(d["name"], "kick"), ",")).otherwise(F.array_join(X.existence_variants(d["name"], "twitch"), ",")), "canonical": lambda d: X.canonical_handle(d["platform"], d["name"]),
    },
)

# --- addresses and mentions

golden(
    "url_identity_branches", "pages", "page_id", "url",
    [
        (("https://instagram.com/Exa{k}?hl=en",), ("instagram", "exa{k}", True)), (("https://youtube.com/@Cre{k}",), ("youtube", "cre{k}", True)), (("https://youtube.com/channel/UC{k}",), ("youtube", "channel:uc{k}", True)),
        (("https://x.com/cre{k}/",), ("x", "cre{k}", True)), (("https://www.tiktok.com/@cre{k}",), ("tiktok", "cre{k}", True)), (("kick.com/the_real_{k}",), ("kick", "the-real-{k}", True)),
        (("https://linktr.ee/cre{k}",), ("linktree", "cre{k}", True)), (("https://cre{k}.carrd.co",), ("linkhub", "carrd.co/cre{k}", True)), (("bit.ly/a{k}",), (None, None, None)),
        (("https://youtube.com/watch?v={k}",), (None, None, None)), (("instagram.com/p/{k}",), (None, None, None)), (("twitter.com/intent/tweet",), (None, None, None)), (("discord.gg/ab{k}",), ("discord", "ab{k}", False)),
        (("instant-gaming.com/?igr=c{k}",), ("website", "instant-gaming.com", False)), (("instagram.com/kick",), ("instagram", "kick", False)), (("https://my{k}.example/about",), ("website", "my{k}.example", True)),
        (("https://my{k}.example/?ref=a",), ("website", "my{k}.example", False)), (("https://m.youtube.com/user/Some{k}",), ("youtube", "some{k}", True)), (("youtu.be/a{k}",), (None, None, None)), (("",), (None, None, None)), ((None,), (None, None, None)),
        (("https://www.reddit.com/user/R{k}",), ("reddit", "r{k}", True)), (("https://www.facebook.com/profile.php?id={k}",), ("facebook", "id:{k}", True)),
    ],
    {"kind": lambda d: url_identity(d["url"])["kind"], "identity": lambda d: url_identity(d["url"])["identity"], "is_unique": lambda d: url_identity(d["url"])["is_unique"]},
)

golden(
    "profile_identities", "pages", "page_id", "platform username link text",
    [
        (("twitch", "me", None, "Insta: @Creator.N{k} | Twitter @crea_{k} | kick: the_real_{k}"), ("instagram:creator.n{k} x:crea_{k} kick:the-real-{k}",)),
        (("twitch", "me", None, "French twitch streamer and kick streamer"), ("",)), (("twitch", "me", None, "see twitch.tv/me"), ("",)), (("kick", "a-{k}", "https://kick.com/a_{k}", None), ("",)),
        (("kick", "me", "https://instagram.com/Abc{k}", "https://instagram.com/abc{k} and https://x.com/zed{k}"), ("instagram:abc{k} x:zed{k}",)), (("kick", "me", None, None), ("",)),
    ],
    {"found": lambda d: F.array_join(F.transform(extract_identities(d["platform"], d["username"], F.when(d["link"].isNotNull(), F.array(d["link"])), d["text"], F.lit(None).cast("string")), lambda i: F.concat(i["kind"], F.lit(":"), i["identity"])), " ")},
)

golden(
    "personal_websites", "pages", "page_id", "domain name",
    [(("nova{k}.example", "nova{k}zz"), (Sql("k >= 0"),)), (("shop.novastar.example", "novastar"), (True,)), (("abc.example", "abc"), (False,)), (("store.example", "luna"), (False,)), (("novastarfan.co", "novastar"), (True,))],
    {"personal": lambda d: website_is_personal(d["domain"], F.array(d["name"]))},
)

golden(
    "cell_texts", "pages", "page_id", "text",
    [
        (("https://a.example/{k} b c\nd",), ("https://a.example/{k}", "https_a.example_{k} b c_d", "https://a.example/{k} b c\nd_processed.xlsx", False)),
        (("http://x/default-avatar/{k}.png",), (None, "http_x_default-avatar_{k}.png", "http://x/default-avatar/{k}_processed.xlsx", True)),
        (("list{k}.xlsx",), (None, "list{k}.xlsx", "list{k}_processed.xlsx", False)), (("m{k}.XLSM",), (None, "m{k}.XLSM", "m{k}_processed.xlsm", False)), (("",), (None, "", "_processed.xlsx", True)),
    ],
    {"url": lambda d: X.first_url(d["text"]), "safe": lambda d: X.safe_filename(d["text"]), "output": lambda d: X.output_filename(d["text"]), "no_picture": lambda d: X.default_avatar(d["text"])},
)

golden(
    "hidden_secrets", "events", "event_id", "name value",
    [(("api_key", "v{k}"), ("***",)), (("API-Key", "v{k}"), ("***",)), (("Authorization", "Bearer {k}"), ("***",)), (("user", "v{k}"), ("v{k}",)), (("refresh_token", None), ("***",)), (("page", None), (None,))],
    {"shown": lambda d: X.hidden_secret(d["name"], d["value"])},
)

# --- signals


def _profile(**columns: Column) -> Column:
    from .. import schemas

    fields = [f.split() for f in schemas.PROFILE.split(", ")] + [["identities", f"array<{IDENTITY}>"]]
    return F.struct(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def _signal_outputs(build: Callable[[DataFrame], Column]) -> dict[str, Callable[[DataFrame], Column]]:
    return {c: (lambda d, c=c: rounded(build(d)[c]) if c in ("score", "points") else build(d)[c]) for c in ("available", "score", "points", "strength")}


golden(
    "display_name_signal", "customer", "c_custkey", "sd su cd cu",
    [
        (("Marco Polo", "mp_{k}x", "marco_polo", "other{k}"), (True, 0.97, 10.0, "supporting")), (("Lunaticzz", "lunaticzz", "LUNATICZZ", "lunaticzz"), (True, 1.0, 3.0, "weak")),
        ((None, "a{k}", None, "a{k}"), (False, None, 0.0, "none")), (("Novastarling", "q{k}", None, "novastarling"), (True, 1.0, 10.0, "supporting")), (("xqc", "aaaa", "pokimane", "zzzz"), (True, Sql(f"round(greatest({_fuzzy_sql('xqc', 'pokimane')}, {_fuzzy_sql('xqc', 'zzzz')}, {_fuzzy_sql('aaaa', 'pokimane')}), 9)"), 0.0, "none")),
    ],
    _signal_outputs(lambda d: signals.display_name(_profile(display_name=d["sd"], username=d["su"]), _profile(display_name=d["cd"], username=d["cu"]), W)),
)


def _ids(value: Column) -> Column:
    """Identities from "kind:identity" words; an exclamation mark means that it tells nobody apart."""
    words = F.filter(F.split(F.coalesce(value, F.lit("")), " "), lambda x: x != "")
    kind = lambda x: F.split_part(x, F.lit(":"), F.lit(1))
    return F.transform(words, lambda x: F.struct(kind(x).alias("kind"), F.replace(F.split_part(x, F.lit(":"), F.lit(2)), F.lit("!"), F.lit("")).alias("identity"), F.lit("").alias("url"), (~x.endswith("!")).alias("is_unique"), F.lit("url").alias("via")))


golden(
    "shared_social_signal", "customer", "c_custkey", "s c held",
    [
        (("instagram:a{k} x:b", "instagram:a{k}", None), (True, 1.0, 25.0, "strong")), (("instagram:a{k} x:b{k}", "x:b{k} instagram:a{k}", None), (True, 1.0, 33.0, "strong")),
        (("instagram:a{k}", "instagram:a{k}", "instagram:a{k}"), (True, 0.3, 2.0, "weak")), (("instagram:a{k}", "instagram:z{k}", None), (True, 0.0, -3.0, "negative")), (("instagram:a{k}", "", None), (False, None, 0.0, "none")),
        (("discord:a{k}!", "discord:a{k}!", None), (True, 0.3, 2.0, "weak")), (("instagram:a{k}", "tiktok:a{k}", None), (True, 0.0, 0.0, "none")), (("website:novastar.example", "website:novastar.example", None), (True, 1.0, 25.0, "strong")),
        (("website:store.example", "website:store.example", None), (True, 0.3, 2.0, "weak")), (("twitch:a{k}", "twitch:a{k}", None), (False, None, 0.0, "none")), (("x:a{k} tiktok:a{k} threads:a{k} vk:a{k}", "x:a{k} tiktok:a{k} threads:a{k} vk:a{k}", None), (True, 1.0, 41.0, "strong")),
    ],
    _signal_outputs(lambda d: signals.shared_socials(_profile(username=F.lit("novastar"), identities=_ids(d["s"])), _profile(username=F.lit("other"), identities=_ids(d["c"])), W, F.when(d["held"].isNotNull(), F.create_map(d["held"], F.lit(10).cast("bigint"))))),
)

_TWELVE = "painter sculptor musician botanist geologist surgeon carpenter plumber architect chemist librarian astronaut"
golden(
    "bio_signal", "customer", "c_custkey", "a b near",
    [
        ((_TWELVE, _TWELVE.upper(), None), (True, 1.0, 10.0, "strong")), (("painter sculptor musician botanist geologist surgeon", "painter sculptor musician botanist geologist surgeon", None), (True, 1.0, 10.0, "supporting")),
        (("aaaa bbbb cccc", "dddd eeee ffff", None), (True, 0.0, 0.0, "none")), (("painter sculptor", "painter sculptor", None), (False, None, 0.0, "none")), (("aaaa bbbb cccc", "dddd eeee ffff", "0.95"), (True, 1.0, 10.0, "supporting")),
        (("aaaa bbbb cccc", "dddd eeee ffff", "0.7"), (True, Sql("round((0.7 - 0.55) / 0.4, 9)"), Sql("round(10 * ((0.7 - 0.55) / 0.4 - 0.3) / 0.5, 9)"), "weak")), (("stream twitch the and follow", "stream twitch the and follow", None), (False, None, 0.0, "none")),
    ],
    _signal_outputs(lambda d: signals.bio(_profile(description=d["a"]), _profile(description=d["b"]), W, d["near"].cast("double"))),
)

golden(
    "content_signal", "customer", "c_custkey", "ca la ta cb lb tb",
    [
        (("Elden Ring", "Español", None, "elden ring", "es", None), (True, 1.0, 5.0, "supporting")), (("Just Chatting", "fr", None, "Just Chatting", "de", None), (True, Sql("round(0.45 * 0.3 / 0.65, 9)"), Sql("round(5.0 * 0.45 * 0.3 / 0.65, 9)"), "weak")),
        ((None, None, "speed-run,co op", None, None, "speedrun,other"), (True, Sql("round(1.0 / 3, 9)"), Sql("round(5.0 / 3, 9)"), "weak")), ((None, None, None, "Chess", "fr", "a"), (False, None, 0.0, "none")),
        (("Hades", None, "rogue,fan", "Hades", None, "rogue,fan"), (True, 1.0, 5.0, "supporting")), (("Hades", "fr", None, "Celeste", "de", None), (True, 0.0, 0.0, "none")),
    ],
    _signal_outputs(lambda d: signals.content(_profile(category=d["ca"], language=d["la"], tags=F.split(d["ta"], ",")), _profile(category=d["cb"], language=d["lb"], tags=F.split(d["tb"], ",")), W)),
)

golden(
    "rule_hit_cases", "customer", "c_custkey", "su cu sb cb picture",
    [
        (("a.b{k}", "A_b{k}", None, None, "none"), ("exact same name", "")), (("a{k}", "b{k}", " one  bio ", "one bio", "strong"), ("same profile picture + exact same bio", "")),
        (("a{k}", "a{k}", "x", "x", "strong"), ("exact same name + same profile picture + exact same bio", "")), (("a{k}", "b{k}", "", "", "negative"), ("", "picture")), (("", "", None, None, "weak"), ("", "")),
    ],
    {
        "hits": lambda d: F.array_join(_hits(d), " + "),
        "problems": lambda d: F.array_join(decide.contradictions(_profile(), _profile(), F.lit("France"), _picture_of(d["picture"]), _hits(d)), ";"),
    },
)


def _picture_of(strength: Column) -> Column:
    return F.array(signals.signal("profile_image", "image", F.lit(True), F.lit(0.5), F.lit(0.0), strength))


def _hits(d: DataFrame) -> Column:
    return decide.rule_hits(_profile(username=d["su"], description=d["sb"]), _profile(username=d["cu"], description=d["cb"]), _picture_of(d["picture"]))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round_even((o_orderkey % 1009) / 1013.0, 4) END AS username, o_orderkey % 2 = 0 AS instagram, o_orderkey % 5 = 0 AS linked, o_orderkey % 7 = 0 AS strong_social,
  CASE WHEN o_orderkey % 7 = 0 THEN 'instagram:a,x:b' ELSE '' END AS shared, o_orderkey % 11 < 4 AS country,
  'for: ' || CASE WHEN o_orderkey % 11 < 4 THEN 'country 100%' ELSE '' END || '; against: ' || CASE WHEN o_orderkey % 5 = 1 THEN 'cross_link 0%' ELSE '' END AS reason FROM orders""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of a pair as one flat struct, and the reason in words."""
    k = F.col("o_orderkey")
    built = F.array(
        signals.signal("username", "name", k % 3 > 0, (k % 1009) / 1013.0, F.lit(0.0), F.lit("none")),
        signals.signal("shared_socials", "social", F.lit(True), F.lit(0.0), F.lit(0.0), F.when(k % 7 == 0, "strong").otherwise("none"), instagram_match=k % 2 == 0, shared_unique=F.when(k % 7 == 0, "instagram:a,x:b").otherwise("")),
        signals.signal("cross_link", "link", F.lit(True), F.lit(0.0), F.lit(0.0), F.when(k % 5 == 0, "strong").when(k % 5 == 1, "conflict").otherwise("none")),
        signals.signal("country", "country", F.lit(True), F.lit(1.0), F.when(k % 11 < 4, 2.0).otherwise(0.0), F.lit("none")),
    )
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", built.alias("signals")).withColumn("e", decide.evidence(F.col("signals")))
    return o.select(
        "o_orderkey", F.col("e.username_similarity").alias("username"), F.col("e.instagram_match").alias("instagram"), F.col("e.explicit_cross_link").alias("linked"), F.col("e.social_link_match").alias("strong_social"),
        F.col("e.shared_social_accounts").alias("shared"), F.col("e.country_match").alias("country"), decide.reason(F.col("signals")).alias("reason"),
    )


# --- lookups and candidates


@query("""WITH k AS (SELECT c_custkey, 'user_' || c_custkey AS source_key FROM customer), t AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'user_' ELSE 'user-' END || s_suppkey AS username, s_name FROM supplier)
SELECT source_key, coalesce(a.username, b.username) AS username, coalesce(a.s_name, b.s_name) AS s_name FROM k LEFT JOIN t a ON a.username = source_key LEFT JOIN t b ON b.username = replace(source_key, '_', '-')""")
def source_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's key with the account that exists under it or, for this platform, under its other spelling."""
    keys = S.table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), "c_custkey").alias("source_key"))
    there = S.table(spark, sf_dir, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "user_").otherwise("user-"), "s_suppkey").alias("username"), "s_name")
    return blocking.existing(keys, there, "kick").select("source_key", "profile.username", "profile.s_name")


_CAPPED = """WITH h AS (SELECT c_custkey AS n, 'src' || c_custkey AS source_key, u.handle, u.linked, u.ord, u.alike FROM customer, LATERAL (VALUES
  ('zz' || c_custkey, true, 0, 0.0), ('novastarq' || c_custkey, false, 1, 1.0), ('novastarq' || c_custkey || 'tv', false, 2, 0.86), ('novastarq' || c_custkey || 'live', false, 3, 0.86)) AS u(handle, linked, ord, alike)),
f AS (SELECT h.* FROM h WHERE NOT (n % 5 = 0 AND ord = 1) AND NOT (n % 3 = 0 AND ord = 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY linked DESC, CASE WHEN linked THEN 0 ELSE alike END DESC, ord) AS place FROM f)
SELECT source_key, handle, place AS rank FROM r WHERE linked OR place <= 2"""


@query(_CAPPED)
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked accounts and the most similar names, two in all; rejected pairs go, and handles without an account."""
    c = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.concat(F.lit("src"), "c_custkey").alias("source_key"), F.concat(F.lit("novastarq"), "c_custkey").alias("base"))
    sources = c.select("source_key", F.col("base").alias("username"), F.lit(None).cast("string").alias("display_name"))
    handle = lambda name, via, i: F.struct(name.alias("handle"), F.lit(via).alias("via"), F.lit(i).alias("ord"))
    some = F.array(handle(F.concat(F.lit("zz"), "n"), "explicit_link", 0), handle(F.col("base"), "exact_username", 1), handle(F.concat("base", F.lit("tv")), "username_variant", 2), handle(F.concat("base", F.lit("live")), "username_variant", 3))
    asked = c.select("source_key", F.explode(some).alias("h")).select("source_key", "h.*")
    there = asked.join(c.filter("n % 3 = 0").select("source_key", F.concat("base", F.lit("tv")).alias("handle")), ["source_key", "handle"], "left_anti").select(F.col("handle").alias("username"), F.lit(None).cast("string").alias("display_name"))
    rejected = c.filter("n % 5 = 0").select("source_key", F.col("base").alias("handle"))
    found = blocking.candidates(sources, blocking.merged(asked), there, rejected, 2)
    return found.select("source_key", "handle", F.col("rank").cast("long").alias("rank"))


@query("""WITH u AS (SELECT 's' || (page_id % 50) AS source_key, page_id AS rank, CASE page_id % 4 WHEN 0 THEN 'https://www.twitch.tv/User' || (page_id % 7) WHEN 1 THEN 'https://twitch.tv/directory/x' WHEN 2 THEN 'https://other.example/a' ELSE 'https://m.twitch.tv/u_' || (page_id % 9) || '/about' END AS url FROM pages),
h AS (SELECT source_key, min(rank) AS rank, CASE WHEN url LIKE 'https://www.twitch.tv/%' THEN lower(substr(url, 23)) ELSE split_part(substr(url, 21), '/', 1) END AS handle FROM u WHERE url LIKE '%twitch.tv/User%' OR url LIKE '%twitch.tv/u_%' GROUP BY ALL),
f AS (SELECT source_key, min(rank) AS rank, handle FROM h WHERE CAST(substr(source_key, 2) AS INT) >= 10 GROUP BY ALL)
SELECT source_key, handle, ord FROM (SELECT *, 2000 + row_number() OVER (PARTITION BY source_key ORDER BY rank, handle) AS ord FROM f) WHERE ord <= 2003""")
def search_fallback_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that web results point at, for sources that have no plausible candidate."""
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://www.twitch.tv/User"), k % 7)).when(k % 4 == 1, "https://twitch.tv/directory/x").when(k % 4 == 2, "https://other.example/a").otherwise(F.concat(F.lit("https://m.twitch.tv/u_"), k % 9, F.lit("/about")))
    urls = S.table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), k % 50).alias("source_key"), k.alias("rank"), url.alias("url"))
    plausible = urls.select("source_key").distinct().filter(F.substring("source_key", 2, 9).cast("int") < 10)
    return blocking.search_fallback(urls, "twitch", plausible, 3).select("source_key", "handle", F.col("ord").cast("long").alias("ord"))


golden(
    "lookup_key_cases", "customer", "c_custkey", "source_value",
    [(("User_{k}",), ("user_{k}",)), (("https://kick.com/Foo-{k}",), ("foo-{k}",)), ((" N/A ",), (None,)), (("bad name {k}!",), ("invalid:bad name {k}!",)), ((None,), (None,)), (("@x{k}",), ("x{k}",))],
    {"source_key": lambda d: blocking.lookup_keys(d, "kick")["source_key"]},
)
# lookup_keys works on tables
QUERIES["lookup_key_cases"] = lambda spark, sf_dir: _lookup_keys(spark, sf_dir)


def _lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.when(k % 6 == 0, F.concat(F.lit("User_"), k)).when(k % 6 == 1, F.concat(F.lit("https://kick.com/Foo-"), k)).when(k % 6 == 2, " N/A ").when(k % 6 == 3, F.concat(F.lit("bad name "), k, F.lit("!"))).when(k % 6 == 5, F.concat(F.lit("@x"), k))
    return blocking.lookup_keys(S.table(spark, sf_dir, "customer").select(k.alias("k"), value.alias("source_value")), "kick").select("k", "source_key")


# --- what is kept, and rows without a write


@query(f"""WITH {S.EVIDENCE_SQL}, c AS (SELECT 'user-' || o_custkey AS source_key, k, decision, points, round_even(confidence, 1) AS confidence FROM final JOIN orders ON o_orderkey = k),
p AS (SELECT *, row_number() OVER w AS place, first_value(k) OVER (PARTITION BY source_key ORDER BY CASE decision WHEN 'MATCH' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END DESC, confidence DESC, points DESC, k) AS best FROM c WINDOW w AS (PARTITION BY source_key ORDER BY confidence DESC, points DESC, k)),
s AS (SELECT *, max(CASE WHEN k = best AND place > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY source_key) AS shifted FROM p),
q AS (SELECT source_key, k, CASE WHEN shifted = 1 THEN CASE WHEN k = best THEN 1 ELSE place + 1 END ELSE place END AS place FROM s)
SELECT source_key, k AS ord, place FROM q WHERE place <= 3""")
def stored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three candidates that are kept for each source, its best always among them."""
    scored = decide.evaluated(S.evidence(spark, sf_dir), W)
    return decide.stored(scored, decide.aggregated(scored), 3).select("source_key", "ord", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey AS original_row, 'SKIPPED_EMPTY' AS status, 'EMPTY_SOURCE' AS state_case, false AS write_destination, false AS write_remarks FROM orders WHERE o_custkey % 3 = 0")
def rows_without_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("original_row"))
    return rows.outcome_without_write(o, "SKIPPED_EMPTY", "EMPTY_SOURCE").select("original_row", "status", "state_case", "write_destination", "write_remarks")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 40")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest jobs: the limit is the feature."""
    jobs = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.struct("o_totalprice", -F.col("o_orderkey")).alias("created_at"))
    return rows.recent_jobs(jobs, 40).select("o_orderkey", "o_totalprice")


# --- sheets


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to sheets, as rows with both id columns filled differently."""
    k = F.col("c_custkey")
    return S.table(spark, sf_dir, "customer").select((k % 4).alias("sheet"), k.cast("int").alias("original_row"), F.when(k % 4 != 1, F.concat(F.lit("a"), k)).alias("kick"), F.when((k % 4 < 2) | (k % 8 == 2), F.concat(F.lit("b"), k)).alias("twitch"))


@query("""WITH r AS (SELECT c_custkey % 4 AS sheet, CASE WHEN c_custkey % 4 <> 1 THEN 1 ELSE 0 END AS kick, CASE WHEN c_custkey % 4 < 2 OR c_custkey % 8 = 2 THEN 1 ELSE 0 END AS twitch FROM customer)
SELECT sheet, avg(kick) AS kick_rate, avg(twitch) AS twitch_rate, CASE sheet WHEN 0 THEN 'twitch' WHEN 1 THEN 'twitch' ELSE NULL END AS twitch_first, CASE sheet WHEN 0 THEN 'kick' WHEN 1 THEN NULL ELSE 'kick' END AS kick_first FROM r GROUP BY sheet""")
def platform_of_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which platform a sheet's sources are of, by the order of its columns and by how full they are."""
    rates = _filled(spark, sf_dir).groupBy("sheet").agg(*[F.avg((~X.is_blank(F.col(c))).cast("int")).alias(f"{c}_rate") for c in ("kick", "twitch")])
    told = lambda first: sheet.detected_platform(F.lit(first), F.col("kick_rate"), F.col("twitch_rate"))
    return rates.select("sheet", "kick_rate", "twitch_rate", told(False).alias("twitch_first"), told(True).alias("kick_first"))


@query("""SELECT 'S' || s AS sheet, header, CASE header WHEN 'remarks' THEN CASE WHEN s % 2 = 0 THEN 3 ELSE 4 END WHEN 'twitch_id_link' THEN CASE WHEN s % 2 = 0 THEN 4 ELSE 5 END ELSE CASE WHEN s % 2 = 0 THEN 5 ELSE 6 END END::INT AS col, NOT (header = 'remarks' AND s % 2 = 0) AS is_new
FROM (SELECT DISTINCT n_nationkey AS s FROM nation), (VALUES ('remarks'), ('twitch_id_link'), ('kick_id_link')) AS h(header)""")
def planned_sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where remarks and links go in a sheet for each nation; every second one has a remarks column already."""
    n = S.table(spark, sf_dir, "nation").select(F.concat(F.lit("S"), "n_nationkey").alias("sheet"), (F.col("n_nationkey") % 2).alias("odd"))
    names = F.when(F.col("odd") == 0, F.array(*map(F.lit, ["id_kick", "id_twitch", "Remarks"]))).otherwise(F.array(*map(F.lit, ["Kick ID", "x", "twitch"])))
    cells = n.select("sheet", F.lit(2).alias("row"), F.posexplode(names).alias("at", "value")).select("sheet", "row", (F.col("at") + 1).alias("col"), "value")
    return sheet.planned_columns(cells, sheet.header(cells)).select("sheet", "header", "col", "is_new")


@query("""SELECT c_custkey::INT AS original_row FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_custkey % 10 = 3 OR c_custkey % 10 = 7) WHERE n <= 25""")
def malformed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows with a source that can't be a name: the limit is the feature."""
    k = F.col("c_custkey")
    value = F.when(k % 10 == 3, F.concat(F.lit(" two words "), k)).when(k % 10 == 7, F.repeat(k.cast("string"), 70)).otherwise(F.concat(F.lit(" user"), k, F.lit(" ")))
    return sheet.malformed(S.table(spark, sf_dir, "customer").select(k.cast("int").alias("original_row"), value.alias("source_value"))).select("original_row")


@query("""WITH n AS (SELECT count(*) FILTER (s_suppkey % 7 IN (3, 5)) AS n FROM supplier) SELECT n = 0 AS ok, 2 * n AS n_mismatches, least(2 * n, 50) AS n_told FROM n""")
def output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an output may leave: cells that differ count, and so do rows whose source stands elsewhere."""
    from .catalogue import _cells

    before, after = _cells(spark, sf_dir), _cells(spark, sf_dir, True)
    kept = before.filter("col = 1").select("sheet", F.col("row").alias("original_row"), F.col("value").alias("source_value"))
    out = sheet.verified(before, after, before.limit(0), kept, 1)
    return out.select("ok", "n_mismatches", F.size("mismatches").cast("long").alias("n_told"))


@query("""WITH v AS (SELECT o_custkey % 200 AS s, o_orderkey % 5 AS t, max(o_totalprice) AS last FROM orders GROUP BY ALL)
SELECT 's' || v.s AS source_key, 't' || v.t AS target_key, (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'CONFIRMED' ELSE 'REJECTED' END FROM orders WHERE o_custkey % 200 = v.s AND o_orderkey % 5 = v.t AND o_totalprice = v.last) AS verdict FROM v""")
def last_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    given = o.select(F.concat(F.lit("s"), F.col("o_custkey") % 200).alias("source_key"), F.concat(F.lit("t"), F.col("o_orderkey") % 5).alias("target_key"), F.when(F.col("o_orderkey") % 2 == 0, "CONFIRMED").otherwise("REJECTED").alias("verdict"), F.col("o_totalprice").alias("updated_at"))
    return decide.latest_verdicts(given).select("source_key", "target_key", "verdict")


@query("SELECT o_custkey AS source_key, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_key"), F.col("o_orderkey").alias("ord"))
    return rows.numbered(o, "source_key", "ord").select("source_key", "ord", F.col("place").cast("long").alias("place"))


# --- reports, snapshots, verdicts and jobs


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored outcomes with two candidates each."""
    k = F.col("original_row")
    evidence = lambda i: F.struct((k % 100 / 100.0).alias("username_similarity"), F.lit(None).cast("double").alias("display_name_similarity"), F.lit(0.5).alias("profile_image_similarity"), F.lit(0.25).alias("bio_similarity"), F.lit(1.0).alias("content_similarity"), (k % 2 == i).alias("explicit_cross_link"), F.when(k % 3 == 0, "instagram:a,x:b").otherwise("").alias("shared_social_accounts"), F.lit(True).alias("country_match"))
    candidate = lambda i: F.struct(F.lit("twitch").alias("platform"), F.concat(F.lit("cand_"), (k + i) % 3).alias("username"), F.when(k % 2 == i, "MATCH").otherwise("REVIEW").alias("decision"), (k % 90 + i).cast("double").alias("confidence"), evidence(i).alias("evidence"), F.array(F.lit("exact_username"), F.lit("search")).alias("via"), F.lit("why").alias("reason"))
    out = S.outcomes(spark, sf_dir).withColumn("source_value", F.upper("source_key")).withColumn("country", F.lit("France")).withColumn("confidence", (k % 90).cast("double"))
    out = out.withColumn("review_candidate", F.when(F.col("decision") == "REVIEW", F.concat(F.lit("cand_"), (k + 1) % 3))).withColumn("destination", F.col("matched_id")).withColumn("remarks", F.lit(None).cast("string"))
    out = out.withColumn("reason", F.when(k % 4 > 0, "because")).withColumn("error_message", F.when(k % 4 == 0, "late")).withColumn("write_destination", F.lit(True)).withColumn("write_remarks", F.lit(False)).withColumn("state_case", F.lit("x"))
    return out.withColumn("candidates", F.array(candidate(0), candidate(1)))


@query(f"""WITH {S.OUTCOMES_SQL} SELECT original_row, source_platform, upper(source_key) AS source_id, 'France' AS country, status, decision, (original_row % 90)::DOUBLE AS confidence, CASE source_platform WHEN 'kick' THEN 'twitch' ELSE 'kick' END AS candidate_platform,
  coalesce(matched_id, CASE WHEN decision = 'REVIEW' THEN 'cand_' || ((original_row + 1) % 3) END) AS candidate_id, matched_id AS written_destination, NULL::VARCHAR AS written_remarks, manual_verdict, CASE WHEN original_row % 4 > 0 THEN 'because' ELSE 'late' END AS reason,
  CASE WHEN decision = 'REVIEW' THEN original_row % 2 = 1 ELSE original_row % 2 = 0 END AS best_linked FROM outcomes""")
def review_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lines; the evidence of a row's best candidate is read back from its JSON."""
    out = report.report_rows(_reported(spark, sf_dir))
    return out.withColumn("best_linked", F.from_json("evidence", "explicit_cross_link boolean")["explicit_cross_link"]).drop("evidence")


@query(f"""WITH {S.OUTCOMES_SQL} SELECT original_row, upper(source_key) AS source_id, 'twitch' AS candidate_platform, 'cand_' || ((original_row + i) % 3) AS candidate_id, CASE WHEN original_row % 2 = i THEN 'MATCH' ELSE 'REVIEW' END AS decision, (original_row % 90 + i)::DOUBLE AS confidence,
  original_row % 100 / 100.0::DOUBLE AS username_sim, NULL::DOUBLE AS display_name_sim, 0.5::DOUBLE AS image_sim, original_row % 2 = i AS explicit_link, CASE WHEN original_row % 3 = 0 THEN 'instagram:a, x:b' ELSE '' END AS shared_socials, 0.25::DOUBLE AS bio_sim, 1.0::DOUBLE AS content_sim,
  true AS country_match, 'exact_username, search' AS discovered_via, 'why' AS reason FROM outcomes, (VALUES (0), (1)) AS v(i)""")
def review_report_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_candidates(_reported(spark, sf_dir))


@query(f"""WITH {S.OUTCOMES_SQL}, c AS (SELECT source_platform, count(*) AS n, count(*) FILTER (status = 'MATCH') AS m, count(*) FILTER (status = 'TEMPORARY_ERROR') AS e,
  count(*) FILTER (status IN ('REVIEW', 'NO_MATCH', 'SOURCE_NOT_FOUND') AND decision = 'REVIEW' AND manual_verdict IS NULL) AS r, count(*) FILTER (status IN ('REVIEW', 'NO_MATCH', 'SOURCE_NOT_FOUND') AND NOT (decision = 'REVIEW' AND manual_verdict IS NULL)) AS x FROM outcomes GROUP BY 1)
SELECT source_platform || '.xlsx' AS filename, v.place, v.name, v.value FROM c, LATERAL (VALUES (1, 'File', source_platform || '.xlsx'), (2, 'Source platform', source_platform), (3, 'Rows', n::VARCHAR), (4, 'Matches', m::VARCHAR), (5, 'No match / not found', x::VARCHAR), (6, 'Review', r::VARCHAR), (7, 'Errors', e::VARCHAR), (8, 'Matching engine version', 'v1')) AS v(place, name, value)""")
def review_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = rows.counters(S.outcomes(spark, sf_dir), "source_platform").withColumn("filename", F.concat("source_platform", F.lit(".xlsx")))
    return report.summary(counted, "v1")


@query(f"""WITH {S.OUTCOMES_SQL} SELECT original_row, source_key, CASE WHEN original_row % 3 = 0 THEN 'MATCH' ELSE status END AS status, CASE WHEN original_row % 3 = 0 THEN 'again' ELSE matched_id END AS matched_id, CASE WHEN original_row % 3 > 0 AND original_row % 4 = 0 THEN 'late' END AS error_message, CASE WHEN original_row % 3 > 0 THEN manual_verdict END AS manual_verdict FROM outcomes""")
def row_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows resolved again: all of what a resolution writes is replaced, nulls too."""
    now = _reported(spark, sf_dir)
    empty = lambda c: F.lit(None).cast(now.schema[c].dataType if c in now.columns else "string")
    given = {"status": F.lit("MATCH"), "matched_id": F.lit("again")}
    again = now.filter("original_row % 3 = 0").select("original_row", *[given.get(c, empty(c)).alias(c) for c in report.WRITTEN])
    return report.upserted(now, again).select("original_row", "source_key", "status", "matched_id", "error_message", "manual_verdict")


@query(f"""WITH {S.EVIDENCE_SQL}, c AS (SELECT 'user-' || o_custkey AS source_key, k, decision FROM final JOIN orders ON o_orderkey = k), p AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY k) AS place FROM c)
SELECT 'job' AS job_id, source_key, k::VARCHAR AS target_key, 'a,b' AS discovered_via, decision, 'v1' AS engine_version FROM p WHERE place <= 2""")
def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rows.numbered(decide.evaluated(S.evidence(spark, sf_dir), W), "source_key", "ord").withColumn("via", F.array(F.lit("a"), F.lit("b"))).withColumn("evidence", decide.evidence(F.col("signals")))
    return report.kept_candidates(scored, "job", "v1", 2).select("job_id", "source_key", "target_key", "discovered_via", "decision", "engine_version")


@query(f"""WITH {S.EVIDENCE_SQL}, c AS (SELECT 'user-' || o_custkey AS source_key, k, decision, points, round_even(confidence, 1) AS confidence FROM final JOIN orders ON o_orderkey = k),
r AS (SELECT source_key, arg_max(k, (CASE decision WHEN 'MATCH' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END, confidence, points, -k)) AS best, max(CASE decision WHEN 'MATCH' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) AS top, count(*) FILTER (decision = 'MATCH') AS n FROM c GROUP BY 1)
SELECT source_key, CASE WHEN top > 0 THEN best::VARCHAR END AS target_key, CASE WHEN n > 1 THEN 'REVIEW' WHEN top = 2 THEN 'MATCH' WHEN top = 1 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision, top > 0 AS has_evidence FROM r""")
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = decide.evaluated(S.evidence(spark, sf_dir), W).withColumn("evidence", decide.evidence(F.col("signals")))
    chosen = decide.aggregated(scored).select("source_key", "decision", F.when(F.col("decision") != "NO_MATCH", F.col("best")).alias("target"), "confidence", F.lit("why").alias("reason"))
    return report.kept_decisions(chosen, scored, "job", "v1").select("source_key", "target_key", "decision", F.col("evidence").isNotNull().alias("has_evidence"))


@query(f"""WITH {S.OUTCOMES_SQL}, g AS (SELECT source_key, 'cand_' || (original_row % 3) AS target_key, CASE original_row % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' END AS verdict, original_row AS updated_at FROM outcomes WHERE original_row % 3 < 2)
SELECT source_key, target_key, arg_max(verdict, updated_at) AS verdict FROM g GROUP BY ALL""")
def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on candidates that the engine found; the last one of a pair counts, and SKIP leaves no trace."""
    from .. import schemas

    k = F.col("original_row")
    known = _reported(spark, sf_dir)
    given = known.select("source_key", F.concat(F.lit("CAND_"), k % 3).alias("target_key"), F.when(k % 3 == 0, "CONFIRM").when(k % 3 == 1, "REJECT").otherwise("SKIP").alias("verdict"), F.timestamp_seconds(k).alias("updated_at"))
    log = spark.createDataFrame([], schemas.VERDICT)
    return decide.latest_verdicts(report.submitted(log, given, known)).select("source_key", "target_key", "verdict")


@query("""SELECT event_id, event_type = 'click' OR (event_type IN ('view', 'purchase') AND event_id % 2 = 0) AS output_available, 'f' || event_id || '_processed.xlsx' AS output_filename, 'f' || event_id || '_review.xlsx' AS review_filename, event_type = 'signup' AND event_id % 3 = 0 AS needs_platform_choice FROM events""")
def job_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "view", "COMPLETED").when(kind == "purchase", "PARTIAL").when(kind == "signup", "UPLOADED").otherwise("PROCESSING")
    jobs = S.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), k, F.lit(".xlsx")).alias("filename"), status.alias("status"), F.when(kind == "click", "there").alias("output_path"), (k % 2 == 0).alias("export_stale"), F.when(k % 3 > 0, "kick").alias("detected_platform"))
    return report.job_view(jobs).select("event_id", "output_available", "output_filename", "review_filename", "needs_platform_choice")


@query("SELECT CAST(s_suppkey + 1 AS INT) AS row, 3 AS col FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey % 3 > 0 AND s_suppkey > 1")
def highlighted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that still carry an earlier run's colour, below a header in row 2."""
    k = F.col("s_suppkey")
    cells = S.table(spark, sf_dir, "supplier").select(F.lit("S").alias("sheet"), (k + 1).cast("int").alias("row"), F.lit(3).alias("col"), F.when(k % 3 == 0, " n/a ").otherwise(F.col("s_name")).alias("value"), F.when(k % 4 != 2, "solid").alias("fill_type"), F.when(k % 4 == 3, "FFFFFFFF").when(k % 4 == 0, None).otherwise("ffffeb9c").alias("fill"))
    return report.stale_highlights(cells, 3, 2).select("row", "col")


@query("""WITH e AS (SELECT user_id, max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS failed FROM events GROUP BY 1), d AS (SELECT user_id, failed, CASE user_id % 3 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision FROM e)
SELECT user_id AS source_key, CASE WHEN failed = 1 AND decision <> 'MATCH' THEN NULL ELSE decision END AS decision, CASE WHEN failed = 1 AND decision <> 'MATCH' THEN 'TEMPORARY_ERROR' ELSE decision END AS status FROM d""")
def transient_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture that could not be fetched must not decide against a source."""
    pairs = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_key"), (F.col("event_id") % 97 == 0).alias("image_failed"))
    k = F.col("source_key") % 3
    decision = F.when(k == 0, "MATCH").when(k == 1, "REVIEW").otherwise("NO_MATCH")
    return report.without_transient(pairs.select("source_key").distinct().select("source_key", decision.alias("decision"), decision.alias("status")), pairs)


@query("""SELECT c_custkey AS source_key, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'MATCH' WHEN c_custkey % 5 = 0 THEN 'REVIEW' ELSE 'NO_MATCH' END AS decision, CASE WHEN c_custkey % 4 < 2 OR c_custkey % 5 = 0 THEN 'old' ELSE 'new' END AS target FROM customer""")
def final_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final rules replace stored decisions, but for missing ones and a human's match; every fifth source has no rule."""
    c = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_key"))
    k = F.col("source_key")
    stored = c.select("source_key", F.when(k % 4 == 1, "MATCH").when(k % 4 > 1, "REVIEW").alias("decision"), F.lit("old").alias("target"), (k % 4 == 1).alias("manual"))
    ruled = c.filter("source_key % 5 > 0").select("source_key", F.lit("NO_MATCH").alias("decision"), F.lit("new").alias("target"))
    return report.finally_decided(stored, ruled).select("source_key", "decision", "target")


@query("""WITH m AS (SELECT 'v1|kick|u' || user_id || '|fr' AS memo_key, arg_max(CASE WHEN event_type <> 'error' THEN event_type END, ts) AS payload, max(ts + CASE WHEN event_type <> 'error' THEN INTERVAL 3 DAY ELSE INTERVAL 6 HOUR END) AS until FROM events GROUP BY 1),
e AS (SELECT 'v1|kick|u' || user_id || '|fr' AS memo_key, ts + CASE WHEN event_type <> 'error' THEN INTERVAL 3 DAY ELSE INTERVAL 6 HOUR END AS expires FROM events)
SELECT memo_key, max(expires) > (SELECT max(ts) FROM events) AS known, strftime(max(expires), '%Y-%m-%dT%H:%M:%S') AS until FROM e GROUP BY 1""")
def remembered_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each user's earlier resolutions is still valid at the time of the last event."""
    e = S.table(spark, sf_dir, "events")
    key = report.memo_key("v1", F.lit("kick"), F.concat(F.lit("u"), "user_id"), F.lit(" FR "))
    at = e.select(key.alias("memo_key"), "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("payload"))
    memo = report.to_remember(at, F.col("ts"))
    last = F.lit(e.agg(F.max("ts")).first()[0]).cast(e.schema["ts"].dataType)
    known, open_ = report.remembered(at.select("memo_key").distinct(), memo, last)
    told = known.select("memo_key", F.lit(True).alias("known")).unionByName(open_.select("memo_key", F.lit(False).alias("known")))
    return told.join(memo.groupBy("memo_key").agg(F.date_format(F.max("expires_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("until")), "memo_key")


@query("""SELECT o_orderkey, least(100, floor(100.0 * (o_orderkey % 130) / 120 + 0.5))::INT AS done, CASE WHEN o_orderkey % 5 = 0 THEN '–' ELSE floor((o_orderkey % 1000) / 10.0 + 0.5)::INT || '%' END AS confidence, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE floor((o_orderkey % 100) / 200.0 * 100 + 0.5)::INT || '%' END AS score,
  CASE WHEN o_orderkey % 3 = 0 THEN 'MATCH' WHEN o_orderkey % 3 = 1 THEN 'no' ELSE 'n/a' END AS flag, CASE o_orderkey % 3 WHEN 0 THEN '—' WHEN 1 THEN 'a, b' ELSE 'n/a' END AS list, CASE WHEN o_orderkey % 3 = 0 THEN 'Kick' WHEN o_orderkey % 3 = 1 THEN 'Twitch' ELSE '—' END AS platform,
  strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S.000000+00:00') AS at FROM orders""")
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b")))
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey", report.percent(k % 130, F.lit(120)).alias("done"), report.shown_confidence(F.when(k % 5 > 0, (k % 1000) / 10.0)).alias("confidence"), report.shown_score(F.when(k % 7 > 0, (k % 100) / 200.0)).alias("score"),
        report.shown_flag(F.when(k % 3 < 2, k % 3 == 0)).alias("flag"), report.shown_list(words).alias("list"), report.shown_platform(F.when(k % 3 == 0, "kick").when(k % 3 == 1, "twitch")).alias("platform"), report.iso(report.utc(F.timestamp_seconds(k))).alias("at"),
    )
