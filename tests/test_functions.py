"""Goldens of the scalar functions. Names, addresses and their results in the tables are fixed values."""

import unicodedata

from pyspark.sql import functions as F

from kinlink import config
from kinlink.functions import links as L
from kinlink.functions import text as X
from kinlink.functions import udfs


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_usernames(spark):
    names = {"MrBeast": "mrbeast", "mr_beast": "mrbeast", "Mr. Beast": "mrbeast", "JoséPeña": "josepena", "__x__": "x", "Müller_TV": "mullertv", "Straße": "strasse", "François": "francois", "": "", None: ""}
    assert values(spark, list(names), X.normalize_username) == list(names.values())
    assert values(spark, ["jimmyboyyy"], X.squash_repeats) == ["jimyboy"]
    cores = values(spark, ["ayzohtv", "davidsantosoficial", "tvtv", "therealmarcotvlive", "xytv", "", None], X.without_affixes)
    assert [c and c.core for c in cores] == ["ayzoh", "davidsantos", "tvtv", "marco", "xytv", "", None]
    assert sorted(cores[3].removed) == ["-live", "-tv", "real-", "the-"]


def test_folds_equal_unicode(spark):
    def folded(t):
        plain = "".join(config.SPECIAL_FOLDS.get(c, c) for c in unicodedata.normalize("NFKC", t))
        return "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))

    texts = ["é è ö ü ñ ç", "e\u0301a", "Straße Ærø Œuvre", "ﬁne ﬄ", "𝓕𝓪𝓷𝓬𝔂 Ｆｕｌｌ", "№ 5 ½ ⑩ ㎏ ™", "Ǆ ǆ ŉ", "ŁÓDŹ İıİ", "αβγ άέ", "日本 テスト ｶﾞ", "x😀y", "a\\]^-[b é"]
    texts += [chr(c) + "z" for c in range(0x80, 0x2FF00, 37) if not (0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF or 0x1100 <= c <= 0x11FF)]
    assert values(spark, texts, X.fold) == [folded(t) for t in texts]
    assert values(spark, [" ÉTÉ ", "Ｆｕｌｌ", "STRASSE", "straße", "ΣΑΣ", "σας"], X.casefold) == ["été", "full", "strasse", "strasse", "σασ", "σασ"]
    d = values(spark, ["bobinice7676", "noni", ""], X.distinctiveness)
    assert d[0] == 1.0 and d[0] > d[1] and d[2] == 0.0
    assert values(spark, ["fooBar_baz"], X.tokenize_name, "string") == [["foo", "bar", "baz"]]


def test_name_similarity(spark):
    ranges = [
        ("starwraith", "starwraith", 1.0, 1.0), ("MrBeast", "mr_beast", 0.97, 0.97), ("ayzoh", "ayzohtv", 0.84, 0.90), ("marco", "marcolive", 0.80, 0.90),
        ("davidsantos-", "davidsantos_oficial", 0.84, 0.90), ("nikkilve", "NikkLive_", 0.75, 0.90), ("jimmyboyyy", "jimmyboy", 0.90, 0.96), ("bobinice7676", "bobinice76", 0.84, 0.96),
        ("xqc", "pokimane", 0, 0.5), ("abc", "abcgaming", 0, 0.85), ("", "x", 0, 0), (None, "x", 0, 0), ("!!", "x", 0, 0),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in ranges], "a string, b string")
    for (a, b, low, high), r in zip(ranges, df.select(X.name_similarity(F.col("a"), F.col("b")).alias("s")).collect(), strict=True):
        assert low - 1e-9 <= r.s.score <= high + 1e-9, (a, b, r.s)


def test_addresses(spark):
    goldens = {
        "https://instagram.com/example": ("instagram", "example", True), "http://instagram.com/Example?hl=en": ("instagram", "example", True), "https://m.instagram.com/example": ("instagram", "example", True),
        "https://youtube.com/@CreatorABC": ("youtube", "creatorabc", True), "https://youtube.com/channel/UCabc123": ("youtube", "channel:ucabc123", True), "https://x.com/creator/": ("x", "creator", True),
        "https://www.tiktok.com/@creator": ("tiktok", "creator", True), "kick.com/the_real_abc": ("kick", "the-real-abc", True), "https://linktr.ee/creator": ("linktree", "creator", True),
        "https://creator.carrd.co": ("linkhub", "carrd.co/creator", True), "bit.ly/abc": None, "https://youtube.com/watch?v=1": None, "instagram.com/p/abc": None, "twitter.com/intent/tweet": None,
        "discord.gg/abcdef": ("discord", "abcdef", False), "discord.com/invite/abcdef": ("discord", "abcdef", False), "instant-gaming.com/?igr=creator": ("website", "instant-gaming.com", False),
        "instagram.com/kick": ("instagram", "kick", False), "": None, None: None,
    }
    found = values(spark, list(goldens), L.url_identity)
    assert [r and (r.kind, r.identity, r.is_unique) for r in found] == list(goldens.values())


def test_mentions(spark):
    texts = ["Insta: @Creator.Name | Twitter @crea_tor | kick: the_real_abc", "French twitch streamer and kick streamer", "twitch.tv/me", None]
    none = F.lit(None).cast("array<string>")
    found = values(spark, texts, lambda c: L.extract_identities(F.lit("twitch"), F.lit("me"), none, c, F.lit(None).cast("string")))
    assert [[(i.kind, i.identity) for i in x] for x in found] == [[("instagram", "creator.name"), ("x", "crea_tor"), ("kick", "the-real-abc")], [], [], []]


def test_handles_and_headers(spark):
    assert values(spark, ["_trsnils", "abc", "trsnils_", "quentin-cey"], lambda c: X.to_handle(c, "twitch")) == [None, None, "trsnils_", "quentin_cey"]
    assert {"davidsantos_", "davidsantos", "davidsantos_oficial", "davidsantostv"} <= set(values(spark, ["davidsantos-"], X.name_variants)[0])
    assert values(spark, ["https://kick.com/categories/x", "https://kick.com/Foo-1", "https://x.com/a"], lambda c: X.handle_from_url(c, "kick")) == [None, "foo-1", None]
    assert values(spark, ["  ID_Kick ", "id twitch", "Remarks", "Kick-ID", None], X.normalize_header) == ["id_kick", "id_twitch", "remarks", "id_kick", ""]
    assert values(spark, [" None ", "n/a", "x", None], X.is_blank) == [True, True, False, True]
    assert values(spark, ["English", "fr", "Español", "pt-BR", "", "other", None], X.normalize_language) == ["en", "fr", "es", "pt", None, None, None]
    assert values(spark, ["12.0", " a ", "  ", None], X.cell_text) == ["12", " a ", None, None]
    assert values(spark, ["list.xlsx", "m.XLSM", "x"], X.output_filename) == ["list_processed.xlsx", "m_processed.xlsm", "x_processed.xlsx"]
    assert values(spark, ["https://a/b c\nd", "http://x", None], X.first_url) == ["https://a/b", None, None]


def test_runs_and_cosine(spark):
    assert udfs.common_run("a b c d".split(), "x b c y".split()) == 2 and udfs.common_run([], ["a"]) == 0
    df = spark.createDataFrame([("nikkilve", "nikklive"), ("martha", "marhta"), ("dixon", "dicksonx"), ("a", "b"), ("", "a"), ("x", "x"), ("abcd", "dcba")], "a string, b string")
    found = [r.x for r in df.select(X.jaro_winkler(F.col("a"), F.col("b")).alias("x")).collect()]
    assert [round(x, 6) for x in found] == [0.975, 0.961111, 0.813333, 0.0, 0.0, 1.0, 0.5]
    assert values(spark, ["a b"], lambda c: X.cosine_of_counts(F.array(c), F.array(c))) == [1.0]
    assert values(spark, ["x"], lambda c: X.cosine_of_counts(F.array(c), F.array().cast("array<string>"))) == [0.0]


def test_long_texts_fold_in_time(spark):
    import time

    text = "Été № 5 ½ … word @me x@y.zz a/b www.site.example " + "voilà bon jour " * 300000
    df = spark.createDataFrame([(text,), ("",), (None,), ("WwW.a.example plain #tag　a1",)], "t string")
    begun = time.time()
    found = [r.n for r in df.select(X.bio_tokens(F.col("t"), []).alias("n")).collect()]
    # the table of folds was searched once for each character of the text: several minutes
    assert time.time() - begun < 40
    assert found[0][:6] == ["ete", "no", "word", "zz", "voila", "bon"]
    assert found[0].count("jour") == 300000
    assert found[1:] == [[], [], ["plain", "a1"]]
