"""Provider links and identifiers: detection, extraction, harvesting, cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers in their order, how their links look, and where the id stands.
PROVIDERS = ["mangaupdates", "anilist", "mal", "mangadex", "mangabaka"]
LEGACY = "mangaupdates-legacy"
HOSTS = [("mangaupdates", ["mangaupdates.com"]), ("anilist", ["anilist.co"]), ("mal", ["myanimelist.net"]), ("mangadex", ["mangadex.org"]), ("mangabaka", ["mangabaka.org", "mangabaka.dev"])]
SEGMENTS = {"mangaupdates": "/series/", "anilist": "/manga/", "mal": "/manga/", "mangadex": "/title/"}
SERIES_LINKS = [
    ("mangaupdates", r"mangaupdates\.com/series(?:/|\.html)"),
    ("anilist", r"anilist\.co/manga/"),
    ("mal", r"myanimelist\.net/manga/"),
    ("mangadex", r"mangadex\.org/title/"),
    ("mangabaka", r"^https?://(?:www\.)?mangabaka\.(?:org|dev)/\d+(?:[/?#].*)?$"),
]
HREF = r"""href\s*=\s*["']([^"']+)["']"""
BARE = r"""(?i)https?://(?:www\.)?(?:mangaupdates|anilist|myanimelist|mangadex|mangabaka)[^\s<>"']+"""
LINKS = "struct<" + ",".join(f"{p}:string" for p in PROVIDERS) + ">"


def is_legacy(url: Column) -> Column:
    """Bare digits, or a ``series.html`` address with an ``id`` parameter."""
    url = F.trim(url)
    low = F.lower(url)
    page = F.contains(low, F.lit("/series.html")) & F.contains(low, F.lit("?id="))
    return F.when(F.contains(url, F.lit("/")), page).otherwise(url.rlike("^[0-9]+$"))


def _match(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def extract_id(provider: Column, url: Column) -> Column:
    """Id of a provider in a link; a value without a slash is an id already; else null."""
    url = F.trim(url)
    legacy = _match(url, r"(?i)^[^?]*\?(?:[^#]*?&)??id=([0-9]+)(?:[&#]|$)")
    numeric = _match(url, r"(?i)^.*?mangabaka\.[^/]*/([0-9]+)(?:[/?#]|$)")
    out = F.when(provider == LEGACY, legacy).when(provider == "mangabaka", numeric)
    for name, segment in SEGMENTS.items():
        out = out.when(provider == name, _match(url, f"^.*?{segment}([^/?#]+)"))
    return F.when(url == "", None).when(~F.contains(url, F.lit("/")), url).otherwise(out)


def detect(url: Column) -> Column:
    """Struct ``provider``, ``id`` of a link to a known provider; null for others."""
    low = F.lower(F.trim(url))
    provider = F.lit(None).cast("string")
    for name, hosts in reversed(HOSTS):
        hit = F.lit(False)
        for h in hosts:
            hit = hit | F.contains(low, F.lit(h))
        named = F.when(is_legacy(url), F.lit(LEGACY)).otherwise(F.lit(name)) if name == "mangaupdates" else F.lit(name)
        provider = F.when(hit, named).otherwise(provider)
    id = extract_id(provider, url)
    return F.when(id.isNotNull() & provider.isNotNull(), F.struct(provider.alias("provider"), id.alias("id")))


def link_pairs(links: Column) -> Column:
    """Links struct as an array of ``provider``, ``id``, ``url`` in provider order; links without an id go."""
    rows = []
    for p in PROVIDERS:
        url = links[p]
        provider = F.when(is_legacy(url), F.lit(LEGACY)).otherwise(F.lit(p)) if p == "mangaupdates" else F.lit(p)
        rows.append(F.struct(provider.alias("provider"), extract_id(provider, url).alias("id"), url.alias("url")))
    return F.filter(F.array(*rows), lambda r: r["url"].isNotNull() & r["id"].isNotNull())


def _is_link(pattern: str):
    return lambda url: F.lower(url).rlike(pattern)


def harvest_links(html: Column) -> Column:
    """First link of each provider: ``href`` values first, then bare addresses; ends trimmed of punctuation."""
    urls = F.concat(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), F.regexp_extract_all(html, F.lit(BARE), F.lit(0)))
    neat = F.transform(urls, lambda u: F.regexp_replace(F.trim(u), r"[*)\],;.!?]+$", ""))
    found = []
    for name, pattern in SERIES_LINKS:
        found.append(F.get(F.filter(neat, _is_link(pattern)), F.lit(0)).alias(name))
    return F.struct(*found)


def subtract_links(base: Column, remove: Column) -> Column:
    """Links of ``base`` that ``remove`` does not hold alike."""
    return F.struct(*[F.when(base[p].eqNullSafe(remove[p]), None).otherwise(base[p]).alias(p) for p in PROVIDERS])


def absolute_url(base: str, href: Column) -> Column:
    root = base.rstrip("/")
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(root + "/"), href))


def post_id(url: Column) -> Column:
    """Leading digits of the last path part; null without."""
    return _match(F.regexp_replace(F.trim(url), "/+$", ""), r"/([0-9]+)[^/]*$")


def info_hash(magnet: Column) -> Column:
    """Lower-case hash of a magnet link."""
    return F.lower(_match(magnet, r"xt=urn:btih:([0-9A-Za-z]+)"))


def percent_encoded(text: Column) -> Column:
    """All but letters, digits and ``-_.~`` as %XX of the UTF-8 bytes."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def magnet_link(hash: Column, title: Column) -> Column:
    return F.concat(F.lit("magnet:?xt=urn:btih:"), hash, F.lit("&dn="), percent_encoded(title))


def source_name(name: Column) -> Column:
    """Our name of a provider that a library writes with a prefix or otherwise; null for other origins."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(name)), r"^(?:plugin|api):", ""))
    out = F.lit(None).cast("string")
    # fixed values: names as written, and ours
    for written, ours in [("mangabaka", "mangabaka"), ("mangaupdates", "mangaupdates"), ("manga_updates", "mangaupdates"), ("anilist", "anilist"), ("mal", "mal"), ("myanimelist", "mal"), ("my_anime_list", "mal")]:
        out = F.when(bare == written, F.lit(ours)).otherwise(out)
    return out


def cursor(stamp: Column, id: Column) -> Column:
    """Opaque key of a feed page: base64url without padding of ``stamp:id``."""
    plain = F.base64(F.encode(F.concat_ws(":", stamp.cast("string"), id.cast("string")), "UTF-8"))
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def cursor_parts(text: Column) -> Column:
    """Struct ``stamp``, ``id`` of a cursor; null if it is none."""
    padded = F.rpad(F.translate(text, "-_", "+/"), ((F.length(text) + 3) / 4).cast("int") * 4, "=")
    plain = F.try_to_binary(padded, F.lit("base64"))
    stamp = F.regexp_extract(F.decode(plain, "UTF-8"), r"^(-?\d+):(-?\d+)$", 1).try_cast("bigint")
    id = F.regexp_extract(F.decode(plain, "UTF-8"), r"^(-?\d+):(-?\d+)$", 2).try_cast("bigint")
    return F.when(stamp.isNotNull() & id.isNotNull(), F.struct(stamp.alias("stamp"), id.alias("id")))


def imported_id(address: Column, base: str) -> Column:
    """Post id of a page on the feed's own host (``view`` or ``download``, then digits); null for other hosts and paths."""
    home = base.split("://", 1)[-1].split("/", 1)[0].lower()
    url = F.trim(address)
    own = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1)) == home
    return F.when(own, F.nullif(F.regexp_extract(url, r"^https?://[^/?#]*/+(?:view|download)/+([0-9]+)", 1), F.lit("")))
