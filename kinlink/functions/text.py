"""Column expressions over names, handles, bios, languages and sheet cells."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

_STRIP = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode's idea of it."""
    return F.regexp_replace(c, _STRIP, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values: list[str]) -> Column:
    """An array literal, as one expression."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def one_of(c: Column, values: list[str]) -> Column:
    """The value is among a fixed list."""
    return F.array_contains(listed(values), c)


def mapped(c: Column, table: dict) -> Column:
    """A lookup in a small fixed table; null where it isn't there."""
    entries = ", ".join(f"{quoted(k)}, " + (f"array({', '.join(map(quoted, v))})" if isinstance(v, list) else quoted(v)) for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), c)


def is_blank(c: Column) -> Column:
    """A cell that counts as empty: null, white space or a placeholder."""
    return one_of(F.coalesce(F.lower(strip(c.cast("string"))), F.lit("")), config.PLACEHOLDERS)


def cell_text(c: Column) -> Column:
    """A cell's text, with its outer spaces; null where there is nothing but white space. Whole numbers lose the point."""
    text = F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0+$", "$1")
    return F.when(strip(text) != "", text)


def normalize_header(c: Column) -> Column:
    """A sheet header as a column name, known spellings by their common name."""
    text = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)[\s\-.]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(mapped(text, config.HEADER_ALIASES), text)


@cache
def _folds() -> tuple[str, str, str, str]:
    """By Unicode's own tables: the characters that lose an accent or a form and what they become, those that go, and those that become several with what they become."""
    single, gone, several = {}, [], {}
    for code in [*range(0x80, 0x2FA20), *range(0xE0100, 0xE01F0)]:
        c = chr(code)
        if not (unicodedata.decomposition(c) or unicodedata.combining(c) or c in config.SPECIAL_FOLDS):
            continue
        plain = "".join(config.SPECIAL_FOLDS.get(x, x) for x in unicodedata.normalize("NFKC", c))
        plain = "".join(x for x in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(x))
        if plain == "":
            gone.append(c)
        elif len(plain) == 1 and plain != c:
            single[c] = plain
        elif len(plain) > 1:
            several[c] = plain
    return "".join(single) + "".join(gone), "".join(single.values()), "".join(several), "".join(f"\0{c}{x}" for c, x in several.items()) + "\0"


def _ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def _folded(c: Column) -> Column:
    before, after, several, table = _folds()

    def spelled(x: Column) -> Column:
        at = F.concat(F.lit("\0"), x)
        return F.when(F.contains(F.lit(table), at), F.split_part(F.split_part(F.lit(table), at, F.lit(2)), F.lit("\0"), F.lit(1))).otherwise(x)

    def longer(plain: Column) -> Column:
        # the table is searched once for each different character that becomes several, not for each place
        odd = F.array_distinct(F.split(F.regexp_replace(plain, r"[\x00-\x7F]+", ""), ""))
        return F.aggregate(F.filter(odd, lambda x: (x != "") & F.contains(F.lit(several), x)), plain, lambda text, x: F.replace(text, x, spelled(x)))

    return let(F.translate(c, before, after), longer)


def fold(c: Column) -> Column:
    """Without accents; compatibility forms and special letters become plain ones. Syllables of Korean script stay whole."""
    return let(c, lambda x: F.when(_ascii(x), x).otherwise(_folded(x)))


def casefold(c: Column) -> Column:
    """Without regard to case and to compatibility forms; an accent that stands as a character of its own stays one."""
    forms, plain = _wide_forms()
    wide = lambda x: F.replace(F.translate(F.lower(F.translate(x, forms, plain)), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return let(c, lambda x: strip(F.when(_ascii(x), F.lower(x)).otherwise(wide(x))))


@cache
def _wide_forms() -> tuple[str, str]:
    """The characters that are another form of one character, and that character."""
    single = {c: x for code in [*range(0x80, 0x2FA20)] if unicodedata.decomposition(c := chr(code)).startswith("<") and len(x := unicodedata.normalize("NFKC", c)) == 1}
    return "".join(single), "".join(single.values())


def normalize_username(c: Column) -> Column:
    """Folded, lower case, only letters and digits; empty for null."""
    return F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), "[^0-9a-z]+", "")


def squash_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1+", "$1")


def strip_trailing_digits(c: Column, least: int = 3) -> Column:
    short = F.regexp_replace(c, "[0-9]+$", "")
    return F.when(F.length(short) >= least, short).otherwise(c)


def tokenize_name(c: Column) -> Column:
    """Words of a name, cut at signs and where a capital follows a small letter."""
    cut = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "(?<=[a-z])(?=[A-Z])", " ")
    return F.array_remove(F.split(F.lower(cut), "[^0-9a-z]+"), "")


def distinctiveness(normal: Column) -> Column:
    """How much a normalised name says alone: 0 if empty, else 0.35 to 1 by length, more with digits among letters."""
    both = normal.rlike("[0-9]") & normal.rlike("[a-z]")
    score = (F.length(squash_repeats(normal)) - 2) / F.lit(6.0) + F.when(both, 0.1).otherwise(0.0)
    return F.when(normal == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.35), F.least(F.lit(1.0), score)))


def ngrams(c: Column, n: int) -> Column:
    """The character n-grams of a text, with repeats; a shorter text is one itself."""

    def grams(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1)))
        return F.when(F.length(t) < n, F.array(t)).otherwise(F.transform(starts, lambda i: F.substring(t, i, F.lit(n))))

    return let(c, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets in arrays; 0 if both are empty."""

    def share(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        counts = F.struct(both.alias("both"), (F.size(p["a"]) + F.size(p["b"])).alias("all"))
        return F.when(p["a"].isNotNull() & p["b"].isNotNull(), let(counts, lambda n: F.when(n["all"] > 0, n["both"] / (n["all"] - n["both"])).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))

    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), share)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def jaro_winkler(a: Column, b: Column, weight: float = 0.1) -> Column:
    """Jaro similarity, raised for a common start of up to four characters where it is over 0.7; 0 if one is empty, 1 if both are the same."""

    def met(p: Column) -> Column:
        """left: the characters of a that find their like in b near enough, each its own; rest: b, with marks in place of those."""

        def one(state: Column, i: Column) -> Column:
            c = F.substring(p["a"], i, F.lit(1))
            at = F.position(c, state["rest"], F.greatest(F.lit(1), i - p["reach"]))
            taken = F.struct(F.concat(state["left"], c).alias("left"), F.overlay(state["rest"], F.lit("\0"), at, F.lit(1)).alias("rest"))
            return F.when((at > 0) & (at <= i + p["reach"]), taken).otherwise(state)

        found = F.aggregate(F.sequence(F.lit(1), F.length(p["a"])), F.struct(F.lit("").alias("left"), p["b"].alias("rest")), one)
        return let(found, lambda f: F.struct(p["a"].alias("a"), p["b"].alias("b"), f["left"].alias("left"), f["rest"].alias("rest")))

    def scored(p: Column) -> Column:
        right = F.filter(F.sequence(F.lit(1), F.length(p["b"])), lambda j: F.substring(p["rest"], j, F.lit(1)) == "\0")
        apart = F.aggregate(right, F.struct(F.lit(0).alias("i"), F.lit(0).alias("n")), lambda s, j: F.struct((s["i"] + 1).alias("i"), (s["n"] + F.when(F.substring(p["left"], s["i"] + 1, F.lit(1)) != F.substring(p["b"], j, F.lit(1)), 1).otherwise(0)).alias("n")))["n"]
        m = F.length(p["left"])
        jaro = (m / F.length(p["a"]) + m / F.length(p["b"]) + (m - apart / 2) / m) / 3
        same = lambda k: F.substring(p["a"], 1, k) == F.substring(p["b"], 1, k)
        shorter = F.least(F.length(p["a"]), F.length(p["b"]))
        start = reduce(lambda longer, k: F.when((shorter >= k) & same(k), k).otherwise(longer), range(1, 5), F.lit(0))
        return F.when(m == 0, F.lit(0.0)).otherwise(let(jaro, lambda j: F.when(j <= 0.7, j).otherwise(j + start * weight * (1 - j))))

    pair = F.struct(a.alias("a"), b.alias("b"), F.greatest(F.lit(0), F.floor(F.greatest(F.length(a), F.length(b)) / 2).cast("int") - 1).alias("reach"))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(let(let(pair, met), scored))


def fuzzy(a: Column, b: Column) -> Column:
    """A blend of edit distance, Jaro-Winkler and shared bigrams; 0 if either is empty."""
    blend = 0.45 * levenshtein_similarity(a, b) + 0.40 * jaro_winkler(a, b) + 0.15 * jaccard(ngrams(a, 2), ngrams(b, 2))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(blend)


def without_affixes(name: Column, least: int = 3) -> Column:
    """struct(core, removed): a normalised name without the decorations at its ends, one after the other, while ``least`` letters stay.

    Of those that fit the longest goes first, and of one word its place at the end.
    """
    longest = sorted(config.AFFIXES, key=len, reverse=True)
    known, some = listed(longest), rf"^(?:{'|'.join(longest)})|(?:{'|'.join(longest)})$"

    def shorter(state: Column, _: Column) -> Column:
        core = state["core"]
        fit = F.filter(known, lambda x: (F.length(core) - F.length(x) >= least) & (F.endswith(core, x) | F.startswith(core, x)))

        def cut(x: Column) -> Column:
            ends, rest = F.endswith(core, x), F.length(core) - F.length(x)
            shortened = F.struct(F.when(ends, F.substring(core, F.lit(1), rest)).otherwise(F.substring(core, F.length(x) + 1, rest)).alias("core"), F.array_append(state["removed"], F.when(ends, F.concat(F.lit("-"), x)).otherwise(F.concat(x, F.lit("-")))).alias("removed"))
            return F.when(x.isNull(), state).otherwise(shortened)

        return F.when(F.rlike(core, F.lit(some)), let(F.get(fit, F.lit(0)), cut)).otherwise(state)

    def stripped(plain: Column) -> Column:
        whole = F.struct(plain.alias("core"), F.array().cast("array<string>").alias("removed"))
        # each round takes two letters at least
        return F.when(F.rlike(plain, F.lit(some)), F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(F.length(plain) / 2), F.lit(1)).cast("int")), whole, shorter)).otherwise(whole)

    return let(name, stripped)


def name_similarity(a: Column, b: Column) -> Column:
    """struct(score, method) of two names: the best of several ways to be alike, under their caps."""
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")

    def way(score: Column | float, method: str) -> Column:
        return F.struct((score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"), F.lit(method).alias("method"))

    def best(k: Column) -> Column:
        cut = ((k["ca"] != k["na"]) | (k["cb"] != k["nb"])) & (F.least(F.length(k["ca"]), F.length(k["cb"])) >= 4)
        ways = F.array(
            way(fuzzy(k["na"], k["nb"]), "fuzzy"),
            F.when(squash_repeats(k["na"]) == squash_repeats(k["nb"]), way(0.93, "equal_ignoring_repeated_letters")),
            F.when(cut & (k["ca"] == k["cb"]), way(0.86, "equal_after_affix_removal")),
            F.when(cut & (k["ca"] != k["cb"]), way(F.least(0.92 * fuzzy(k["ca"], k["cb"]), F.lit(0.85)), "fuzzy_after_affix_removal")),
            F.when((k["da"] == k["db"]) & (F.length(k["da"]) >= 5) & ((k["da"] != k["na"]) | (k["db"] != k["nb"])), way(0.84, "equal_ignoring_trailing_digits")),
        )
        return let(F.array_max(F.array_compact(ways)), lambda w: F.struct(F.least(w["score"], F.lit(0.96)).alias("score"), w["method"].alias("method")))

    def apart(n: Column) -> Column:
        forms = {x: n[x] for x in ("na", "nb")} | {f"c{x}": without_affixes(n[f"n{x}"])["core"] for x in "ab"} | {f"d{x}": strip_trailing_digits(n[f"n{x}"]) for x in "ab"}
        empty = (n["na"] == "") | (n["nb"] == "")
        return F.when(empty, way(0.0, "empty_after_normalisation")).when(n["na"] == n["nb"], way(0.97, "equal_after_normalisation")).otherwise(let(F.struct(*[c.alias(x) for x, c in forms.items()]), best))

    plain = F.struct(normalize_username(a).alias("na"), normalize_username(b).alias("nb"))
    return F.when(missing, way(0.0, "missing")).when(casefold(a) == casefold(b), way(1.0, "exact")).otherwise(let(plain, apart))


def name_points(score: Column, weight: float, distinct: Column) -> Column:
    return F.when(score < 0.70, 0.0).otherwise(weight * F.least(F.lit(1.0), (score - 0.70) / 0.27) * distinct)


def name_strength(score: Column) -> Column:
    return F.when(score < 0.70, "none").when(score >= 0.80, "supporting").otherwise("weak")


def name_variants(name: Column) -> Column:
    """Spellings under which an account of this name may exist, in order; empty for null."""
    ends, starts = listed(["", *config.SUFFIXES]), listed(config.PREFIXES)

    def forms(base: Column) -> Column:
        return F.array(
            base, F.replace(base, F.lit(" "), F.lit("")), F.translate(base, " ", "_"), F.translate(base, "-", "_"), F.translate(base, "_", "-"), F.translate(base, ".", "_"),
            F.translate(base, "-_. ", ""), F.regexp_replace(base, "^[_-]+|[_-]+$", ""),
        )

    def cores(n: Column) -> Column:
        every = F.array(n["normal"], n["core"], strip_trailing_digits(n["normal"]), strip_trailing_digits(n["core"]), squash_repeats(n["normal"]))
        return F.filter(F.array_distinct(every), lambda c: F.length(c) >= 3)

    def grown(normal: Column) -> Column:
        found = let(F.struct(normal.alias("normal"), without_affixes(normal)["core"].alias("core")), cores)
        return F.flatten(F.transform(found, lambda c: F.concat(F.transform(ends, lambda e: F.concat(c, e)), F.transform(starts, lambda p: F.concat(p, c)))))

    def every(base: Column) -> Column:
        more = let(normalize_username(base), lambda normal: F.when(normal == "", F.array().cast("array<string>")).otherwise(grown(normal)))
        return F.array_sort(F.array_distinct(F.filter(F.concat(forms(base), more), lambda v: v != "")))

    return let(strip(F.regexp_replace(fold(casefold(F.coalesce(name, F.lit("")))), "^@+", "")), every)


def host_of(url: Column) -> Column:
    """The host of an address with or without a scheme, lower case."""
    return F.lower(F.regexp_extract(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_parts(url: Column) -> Column:
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.array_remove(F.split(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), "")


def handle_rules(platform: str | Column) -> dict[str, Column]:
    """A platform's rules as columns: of its name in ``config``, or of a row of a table of rules (``sources.accounts.RULES``)."""
    if isinstance(platform, Column):
        return {name: platform[name] for name in ("platform", *config.HANDLE_RULES["twitch"], "reserved")}
    held = {"platform": platform, **config.HANDLE_RULES[platform], "reserved": config.SEARCH_RESERVED_PATHS[platform]}
    return {name: listed(v) if isinstance(v, list) else F.lit(v) for name, v in held.items()}


def _translated(c: Column, pair: Column) -> Column:
    return F.call_function("translate", c, pair[0], pair[1])


def normalize_handle(raw: Column, platform: str | Column) -> Column:
    """The handle in a cell, address or @mention; null if it can't be one on this platform."""
    rules = handle_rules(platform)
    text = strip(raw.cast("string"))
    address = text.contains("/") | F.exists(rules["hosts"], lambda h: F.contains(F.lower(text), h))
    bare = F.regexp_replace(text, "^/+", "")
    host = F.regexp_replace(F.regexp_replace(host_of(bare), r"^www\.", ""), r"^m\.", "")
    part = F.when(F.array_contains(rules["hosts"], host), F.coalesce(F.try_element_at(path_parts(bare), F.lit(1)), F.lit("")))
    handle = F.lower(strip(F.regexp_replace(F.when(address, part).otherwise(text), "^@+", "")))
    return F.when(F.rlike(handle, rules["valid"]), handle)


def to_handle(variant: Column, platform: str | Column) -> Column:
    """A name as this platform writes it; null if it can't be a handle."""
    rules = handle_rules(platform)
    v = _translated(F.lower(strip(variant)), rules["written"])
    return F.when(F.rlike(v, rules["variant"]), v)


def existence_variants(handle: Column, platform: str | Column) -> Column:
    """Handles that mean the same account."""
    return F.array_distinct(F.array(handle, _translated(handle, handle_rules(platform)["alike"])))


def canonical_handle(kind: Column, handle: Column) -> Column:
    bare = F.regexp_replace(F.lower(handle), "^@+", "")
    return F.when(kind == "kick", F.translate(bare, "_", "-")).otherwise(bare)


def handle_from_url(url: Column, platform: str | Column) -> Column:
    """The account that a web search result points at; null for other hosts and for pages of the platform itself."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), r"^m\.", "")
    handle = F.lower(F.try_element_at(path_parts(url), F.lit(1)))
    rules = handle_rules(platform)
    return F.when(F.array_contains(rules["hosts"], host) & ~F.array_contains(rules["reserved"], handle) & F.rlike(handle, rules["valid"]), handle)


def display_id(platform: Column, username: Column, display_name: Column) -> Column:
    """How the account is written into the sheet: with the display name's capitals if that is the login."""
    return F.when((platform == "twitch") & (F.lower(display_name) == username), display_name).otherwise(username)


def same_name(a: Column, b: Column) -> Column:
    """Equal but for case and the kind of separators; false for empty names."""
    x, y = (F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)[\s._-]+", "_") for c in (a, b))
    return (x != "") & (x == y)


def same_bio(a: Column, b: Column) -> Column:
    """Equal but for white space; false for empty bios."""
    x, y = (strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")) for c in (a, b))
    return (x != "") & (x == y)


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[\s._-]+", "")


def normalize_language(c: Column) -> Column:
    v = F.lower(strip(fold(c)))
    return (
        F.when(F.coalesce(v, F.lit("")).isin("", *config.NO_LANGUAGE), F.lit(None).cast("string"))
        .when(v.rlike(r"^\p{L}{2}$"), v)
        .when(F.substring(v, 1, 3).rlike("[-_]"), F.substring(v, 1, 2))
        .otherwise(mapped(v, config.LANGUAGE_NAMES))
    )


def country_languages(country: Column) -> Column:
    return mapped(F.lower(strip(fold(F.coalesce(country, F.lit(""))))), config.COUNTRY_LANGUAGES)


# Fixed value: what counts as an address in a text.
_URL = r"(?i)\b((?:https?://|www\.)[^\s<>\"'()\[\]{}]+|(?:[a-z0-9-]+\.)+(?:com|tv|gg|ee|ai|net|org|io|me|fr|de|es|it|co|be|link|bio|page|app|live|to)/[^\s<>\"'()\[\]{}]*)"


def extract_urls(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_URL), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)»”’'\"]+$", ""))


def without_addresses(c: Column) -> Column:
    """Without addresses, mentions, tags and mails; empty for null. Each is looked for only where a sign that it needs is."""

    def cut(pattern: str, needed: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda t: F.when(needed(t), F.regexp_replace(t, pattern, " ")).otherwise(t)

    text = let(F.coalesce(c, F.lit("")), cut(_URL, lambda t: t.contains("/") | t.rlike(r"[wW]{3}\.")))
    text = let(text, cut(r"(?U)[@#]\w+", lambda t: t.contains("@") | t.contains("#")))
    return let(text, cut(r"(?U)\S+@\S+\.\S+", lambda t: t.contains("@")))


def clean_text(c: Column) -> Column:
    """Without addresses, mentions, tags and mails; white space squeezed."""
    return strip(F.regexp_replace(without_addresses(c), r"(?U)\s+", " "))


def bio_tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """The telling words of a bio, in order and with repeats."""
    words = F.regexp_extract_all(F.lower(fold(without_addresses(c))), F.lit("([a-z0-9]{2,})"), F.lit(1))
    # a long list of values becomes a hash set
    return F.filter(words, lambda w: ~w.isin([*config.STOPWORDS, *config.BIO_BOILERPLATE] if stopwords is None else stopwords))


def normalize_tag(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]", "")


def default_avatar(url: Column) -> Column:
    """No picture, or the platform's own."""
    return F.coalesce(url, F.lit("")).isin("") | reduce(Column.__or__, [F.lower(url).contains(m) for m in config.DEFAULT_AVATARS])


def first_url(c: Column) -> Column:
    """The first word of the first line, if it is an https address."""
    word = F.split_part(F.split_part(c, F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1))
    return F.when(word.startswith("https://"), word)


def safe_filename(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"(?U)[^\w.\- ()]+", "_"), F.lit(180))


def output_filename(c: Column, mark: str = "processed") -> Column:
    """stem_processed.xlsx; macro sheets keep their ending."""
    ending = F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))
    return F.concat(F.regexp_replace(c, r"(?<=.)\.[^./]+$", ""), F.lit(f"_{mark}"), F.when(ending.isin(".xlsx", ".xlsm"), ending).otherwise(".xlsx"))


def hidden_secret(key: Column, value: Column) -> Column:
    """The value, or stars where the key names a secret."""
    return F.when(key.rlike("(?i)(token|secret|password|authorization|api[_-]?key)"), F.lit("***")).otherwise(value)


def cosine_of_counts(a: Column, b: Column) -> Column:
    """Cosine of two bags given as arrays with repeats; 0 if either is empty."""

    def count(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x)).cast("double")

    def norm(bag: Column) -> Column:
        return F.sqrt(F.aggregate(F.array_distinct(bag), F.lit(0.0), lambda s, x: s + count(bag, x) * count(bag, x)))

    def cosine(bags: Column) -> Column:
        x, y = bags["a"], bags["b"]
        dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, g: s + count(x, g) * count(y, g))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(dot / (norm(x) * norm(y)))

    return let(F.struct(a.alias("a"), b.alias("b")), cosine)


def hash_similarity(a: Column, b: Column) -> Column:
    """Of two picture hashes struct(p, d, a): one minus the weighted share of differing bits."""

    def bits(name: str) -> Column:
        return F.bit_count(a[name].bitwiseXOR(b[name]))

    return 1 - (0.5 * bits("p") + 0.3 * bits("d") + 0.2 * bits("a")) / 64.0
