"""Addresses and mentions as identities: which account of which network they name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .text import canonical_handle, extract_urls, host_of, let, listed, mapped, one_of, path_parts, strip

IDENTITY = "struct<kind:string,identity:string,url:string,is_unique:boolean,via:string>"

#: How bios mention accounts; the last group is the account.
_MENTION = r"\s*(?:[:\-–→>|]+\s*@?|@)"
MENTIONS = {
    "instagram": rf"(?i)\b((?:instagram|insta|ig){_MENTION}([a-z0-9._]{{2,30}}))",
    "x": rf"(?i)\b((?:twitter|x){_MENTION}([a-z0-9_]{{2,15}})\b)",
    "tiktok": rf"(?i)\b((?:tiktok|tik\s*tok|tt){_MENTION}([a-z0-9._]{{2,24}}))",
    "youtube": rf"(?i)\b((?:youtube|yt){_MENTION}([a-z0-9._-]{{3,30}}))",
    "twitch": rf"(?i)\b(twitch{_MENTION}([a-z0-9_]{{3,25}})\b)",
    "kick": rf"(?i)\b(kick{_MENTION}([a-z0-9_-]{{3,25}})\b)",
}


def _within(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    tails = F.filter(listed(domains), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    return F.size(tails) > 0


def social_host(url: Column) -> Column:
    """The host without the prefixes that networks use for the same site; null if there is none."""
    host = host_of(url)
    for prefix in ("www", "m", "mobile", "web"):
        host = F.regexp_replace(host, rf"^{prefix}\.(?=.*\.)", "")
    host = F.regexp_replace(host, r"^(?!vm\.tiktok\.com$).*\.tiktok\.com$", "tiktok.com")
    return F.when(host.contains("."), host)


def host_kind(host: Column) -> Column:
    """The network of a host, exactly or by the domain above it."""
    above = F.filter(listed(list(config.HOST_KINDS)), lambda d: host.endswith(F.concat(F.lit("."), d)))
    return F.coalesce(mapped(host, config.HOST_KINDS), mapped(F.try_element_at(above, F.lit(1)), config.HOST_KINDS))


def _query_keys(url: Column) -> Column:
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    return F.transform(F.filter(pairs, lambda p: p.rlike("^[^=]+=.")), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))))


def url_identity(url: Column, via: Column | None = None) -> Column:
    """struct(kind, identity, url, is_unique, via) of an address; null where it names no account."""
    parsed = let(strip(F.coalesce(url, F.lit(""))), lambda raw: F.struct(raw.alias("raw"), social_host(raw).alias("host"), path_parts(raw).alias("parts")))
    return let(let(parsed, _located), lambda p: let(_handle(p), lambda handle: _identity(p, handle, F.lit("url") if via is None else via)))


def _located(p: Column) -> Column:
    first, second = (F.coalesce(F.try_element_at(p["parts"], F.lit(i)), F.lit("")) for i in (1, 2))
    return F.struct(p["raw"].alias("raw"), p["host"].alias("host"), p["parts"].alias("parts"), first.alias("first"), second.alias("second"), host_kind(p["host"]).alias("kind"))


def _handle(p: Column) -> Column:
    """The account of a network that a path names; null if it names a page."""
    kind, first, second = p["kind"], p["first"], p["second"]
    after_at = F.substr(first, F.lit(2))
    reserved = F.coalesce(F.array_contains(mapped(kind, config.RESERVED_PATHS), F.lower(first)), F.lit(False))
    page_id = F.regexp_extract(p["raw"], r"[?&]id=([^&#]+)", 1)
    if_second = F.when(second != "", second)
    handle = (
        F.when(kind == "youtube", F.when(first.startswith("@"), after_at).when(first.isin("c", "user") & (second != ""), second).when((first == "channel") & (second != ""), F.concat(F.lit("channel:"), second)).when(~reserved, first))
        .when(kind.isin("tiktok", "threads"), F.when(first.startswith("@"), after_at).when(~(reserved & (first == F.lower(first))), first))
        .when((kind == "instagram") & (first == "stories") & (second != ""), second)
        .when(kind == "snapchat", F.when(first == "add", if_second))
        .when(kind == "reddit", F.when(first.isin("u", "user"), if_second))
        .when((kind == "facebook") & (first == "profile.php"), F.when(page_id != "", F.concat(F.lit("id:"), page_id)))
        .when(kind == "spotify", F.when(second != "", F.concat(first, F.lit(":"), second)))
        .otherwise(F.when(~reserved, first))
    )
    return let(canonical_handle(kind, strip(handle)), lambda h: F.when(F.replace(h, F.lit(":"), F.lit("")).rlike(r"^[a-z0-9._-]{1,64}$"), h))


def _identity(p: Column, handle: Column, via: Column) -> Column:
    kind, host, parts = p["kind"], p["host"], p["parts"]
    clean = F.regexp_replace(F.concat(F.lit("https://"), host, F.lit("/"), F.array_join(parts, "/")), "/+$", "")

    def found(kind: Column, identity: Column, unique: Column) -> Column:
        return F.struct(kind.alias("kind"), identity.alias("identity"), clean.alias("url"), unique.alias("is_unique"), via.alias("via"))

    nothing = F.lit(None).cast(IDENTITY)
    code = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    invite = (code != "") & ((host == "discord.gg") | ((F.size(parts) >= 2) & (p["first"] == "invite")))
    hub = host.endswith(".carrd.co") | host.endswith(".bio.link") | host.endswith(".linktr.ee")
    affiliate = F.arrays_overlap(_query_keys(p["raw"]), listed(config.AFFILIATE_PARAMETERS))
    return (
        F.when((p["raw"] == "") | host.isNull() | one_of(host, config.SHORTENERS), nothing)
        .when(hub, found(F.lit("linkhub"), F.concat(F.regexp_replace(host, r"^[^.]*\.", ""), F.lit("/"), F.split_part(host, F.lit("."), F.lit(1))), F.lit(True)))
        .when(kind.isNull() & _within(host, config.GENERIC_DOMAINS), found(F.lit("website"), host, F.lit(False)))
        .when(kind.isNull(), found(F.lit("website"), host, ~affiliate))
        .when(kind.isin("youtube_video", "tiktok_short"), nothing)
        .when(kind == "discord", F.when(invite, found(kind, code, F.lit(False))))
        .when((F.size(parts) > 0) & (handle != ""), found(kind, handle, ~one_of(handle, config.GENERIC_IDENTITIES)))
        .otherwise(nothing)
    )


def _mentioned(kind: str, pair: Column) -> Column:
    """The identity of one mention (w: all of it, n: the name); null if the name is none."""
    bare = F.lower(F.regexp_replace(pair["n"], "^[._-]+|[._-]+$", ""))
    ok = (F.length(bare) >= 2) & ~bare.isin("com", "tv", "gg")
    if kind in ("twitch", "kick", "x"):
        ok = ok & ~bare.contains(".")
    handle = canonical_handle(F.lit(kind), bare)
    url = F.concat(F.lit("mention:"), strip(pair["w"]))
    return F.when(ok, F.struct(F.lit(kind).alias("kind"), handle.alias("identity"), url.alias("url"), (~one_of(handle, config.GENERIC_IDENTITIES)).alias("is_unique"), F.lit("mention").alias("via")))


def _mention_of(kind: str) -> Callable[[Column], Column]:
    return lambda pair: _mentioned(kind, pair)


def _mentions(text: Column) -> Column:
    """Identities that a text mentions by network and name."""
    out = []
    for kind, pattern in MENTIONS.items():
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        out.append(F.transform(F.arrays_zip(whole.alias("w"), names.alias("n")), _mention_of(kind)))
    return F.concat(*out)


def first_of_each(identities: Column) -> Column:
    """The first identity of each (kind, identity), in order."""
    some = F.filter(identities, lambda i: i.isNotNull())

    def step(kept: Column, i: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["kind"] == i["kind"]) & (k["identity"] == i["identity"])), kept).otherwise(F.array_append(kept, i))

    return F.aggregate(some, F.array().cast(f"array<{IDENTITY}>"), step)


def extract_identities(platform: Column, username: Column, links: Column, description: Column, extra_bio: Column) -> Column:
    """All identities of a profile, first wins: its links, then the addresses and then the mentions in its texts; without the profile itself."""
    text = F.concat_ws("\n", description, extra_bio)
    told = lambda via: lambda u: F.struct(u.alias("url"), F.lit(via).alias("via"))
    own = F.transform(F.coalesce(links, F.array().cast("array<string>")), told("profile_field"))
    urls = F.transform(F.concat(own, F.transform(extract_urls(text), told("url"))), lambda u: url_identity(u["url"], u["via"]))
    found = first_of_each(F.concat(urls, _mentions(text)))
    return F.filter(found, lambda i: ~((i["kind"] == platform) & (i["identity"] == canonical_handle(platform, username))))


def website_is_personal(domain: Column, names: Column) -> Column:
    """The domain's label and one of the normalised names hold each other, over four characters."""
    label = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(F.split(domain, r"\."), F.lit(-2)), domain)), "[^0-9a-z]+", "")
    return F.exists(names, lambda n: (F.length(n) >= 4) & (label.contains(n) | ((F.length(label) >= 4) & n.contains(label))))
