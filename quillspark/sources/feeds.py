"""Release feeds: XML items, paged addresses, conditional reads, JSON indexes."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.functions.values import parse_mail_date, parse_size

#: Fields of an item; elements are matched by local name, so prefixes do not matter.
FIELDS = ["title", "link", "guid", "pubDate", "description", "category", "size", "infoHash"]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files as one string column each of :data:`FIELDS`, split across files and tasks.

    Text and CDATA of an element are joined.  Items that do not parse have
    nulls and are dropped by :func:`releases_of`.
    """
    schema = ", ".join(f"`{p}{f}` string" for f in FIELDS for p in ("",))
    raw = spark.read.format("xml").options(rowTag="item", mode="PERMISSIVE", ignoreNamespace="true").schema(schema).load(path)
    return raw.select(*FIELDS)


def items_of(feeds: DataFrame, body: str = "body") -> DataFrame:
    """The same from feed bodies in a column: one row for each ``<item>``.

    A body without a channel gives no rows.
    """
    chunk = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1)))
    items = feeds.select(*[c for c in feeds.columns if c != body], chunk.alias("_item"))
    return items.select(*[c for c in items.columns if c != "_item"], *[_element(F.col("_item"), f).alias(f) for f in FIELDS])


def _element(item, name: str):
    """Text of the first elements of a local name, CDATA opened, entities decoded."""
    found = F.regexp_extract_all(item, F.lit(rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>"), F.lit(1))
    text = F.array_join(found, "")
    parts = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    # entities hold only outside of CDATA; a text that is all CDATA keeps its own
    plain = F.when(F.contains(text, F.lit("<![CDATA[")), parts)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        parts = F.replace(parts, F.lit(entity), F.lit(char))
    return F.coalesce(plain, parts)


def releases_of(items: DataFrame, source_name: str, kind: str = "feed") -> DataFrame:
    """Discovered releases; items without title, id or date are dropped."""
    title, page = F.trim("title"), F.trim("guid")
    hash = F.nullif(F.lower(F.trim("infoHash")), F.lit(""))
    text = F.nullif(F.trim("description"), F.lit(""))
    rows = items.select(
        F.lit(kind).alias("source_kind"),
        F.lit(source_name).alias("source_name"),
        ids.post_id(page).alias("external_id"),
        title.alias("title"),
        page.alias("link"),
        ids.magnet_link(hash, title).alias("magnet"),
        F.nullif(F.trim("link"), F.lit("")).alias("torrent_url"),
        hash.alias("info_hash"),
        parse_size(F.col("size")).alias("size_bytes"),
        text.alias("description_html"),
        ids.harvest_links(F.coalesce(text, F.lit(""))).alias("external_links"),
        parse_mail_date(F.col("pubDate")).alias("posted_at"),
    )
    return rows.where((F.col("title") != "") & F.col("external_id").isNotNull() & F.col("posted_at").isNotNull())


def page_address(feed: str, page: int, query: str | None = None) -> str:
    """Address of a listing page: no ``page=rss``, ``p`` (and ``q``) replaced, all else kept."""
    parts = urlsplit(feed)
    drop = {"p"} | ({"q"} if query is not None else set())
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in drop and (k, v) != ("page", "rss")]
    if query is not None:
        kept.append(("q", query))
    return urlunsplit(parts._replace(query=urlencode([*kept, ("p", str(page))])))


def imported_id(address: str, base: str) -> str | None:
    """Post id of a page on the feed's own host; null for other hosts and paths."""
    parts, home = urlsplit(address.strip()), urlsplit(base)
    path = [p for p in parts.path.split("/") if p]
    if parts.scheme not in ("http", "https") or parts.netloc.lower() != home.netloc.lower() or len(path) < 2 or path[0] not in ("view", "download"):
        return None
    digits = path[1][: len(path[1]) - len(path[1].lstrip("0123456789"))]
    return digits or None


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items that the feed has not carried before."""
    return items.join(seen.select("external_id"), "external_id", "left_anti")


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (``path``, ``etag``) whose tag is new since the stored state."""
    known = state.select("path", F.col("etag").alias("_etag"))
    return files.join(known, "path", "left").where(~F.col("etag").eqNullSafe(F.col("_etag"))).drop("_etag")


INDEX = "data array<struct<id:string,externalIds:array<struct<source:string,externalId:string,externalUrl:string>>,localMaxVolume:double,localMaxChapter:double,volumesOwned:bigint>>, page bigint, pageSize bigint, total bigint"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Items of paged JSON index files, in page order, with known provider names.

    Pages after the one with which as many items as the total are there, and
    after an empty one, are left out, as a walk over them would not ask for them.
    """
    pages = spark.read.schema(INDEX).option("multiLine", True).json(path)
    # one short row for each page
    sizes = pages.select("page", F.size("data").alias("n"), "total")
    before = Window.partitionBy(F.lit(0)).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    walked = sizes.withColumn("have", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ended", F.coalesce(F.max(F.col("n") <= 0).over(before), F.lit(False)))
    walked = walked.where((F.col("have") < F.coalesce("total", F.lit(2**62))) & ~F.col("ended")).select("page")
    pages = pages.join(F.broadcast(walked), "page", "left_semi")
    items = pages.select("page", F.posexplode("data").alias("pos", "d"))
    named = F.filter(F.transform("d.externalIds", lambda x: F.struct(ids.source_name(x["source"]).alias("provider"), x["externalId"].alias("external_id"))), lambda x: x["provider"].isNotNull())
    return items.select((F.col("page") * 1_000_000 + F.col("pos")).alias("place"), F.col("d.id").alias("item"), named.alias("ids"), F.col("d.localMaxVolume").alias("have_volume"), F.col("d.localMaxChapter").alias("have_chapter"), F.col("d.volumesOwned").alias("volumes_owned"))


PROVIDER = "id bigint, state string, title string, native_title string, romanized_title string, secondary_titles map<string,array<struct<title:string>>>, type string, status string, year int, rating double, final_volume string, total_chapters string, description string, genres array<string>, tags array<string>, source map<string,struct<id:string>>"


_AS_STRUCT = re.sub(r"(^|, )(\w+) ", r"\1\2:", PROVIDER)


def read_provider(spark: SparkSession, path: str) -> DataFrame:
    """Provider records from JSON lines, mapped to the catalog's vocabulary."""
    return provider_records(spark.read.schema(PROVIDER).json(path))


def answers_of(responses: DataFrame) -> DataFrame:
    """Provider records in responses (``status``, ``body``), mapped to the catalog's vocabulary.

    A body is a record or a list of records, bare or as ``data`` of an
    envelope.  Other statuses than 200, as 404 for an unknown id, give no
    rows, and so do bodies that are no JSON and records without an id.
    """
    said = responses.where("status = 200").select(F.coalesce(F.get_json_object("body", "$.data"), "body").alias("data"))
    each = said.select(F.explode(F.when(F.ltrim("data").startswith("["), F.from_json("data", f"array<struct<{_AS_STRUCT}>>")).otherwise(F.array(F.from_json("data", PROVIDER)))).alias("r"))
    return provider_records(each.where("r.id is not null").select("r.*"))


def provider_records(rows: DataFrame) -> DataFrame:
    """Rows as the provider has them (:data:`PROVIDER`), mapped to the catalog's vocabulary."""
    from quillspark.functions import values as va

    other = F.flatten(F.transform(F.map_values("secondary_titles"), lambda t: F.transform(t, lambda x: x["title"])))
    every = F.concat(F.array("native_title", "romanized_title"), F.coalesce(other, F.array().cast("array<string>")))
    provider = lambda k: F.when(k == "manga_updates", "mangaupdates").when(k == "my_anime_list", "mal").otherwise(k)
    pairs = F.transform(F.array_sort(F.map_entries("source")), lambda e: F.struct(provider(e["key"]).alias("provider"), e["value"]["id"].alias("id")))
    foreign = F.coalesce(F.filter(pairs, lambda p: p["id"].isNotNull() & (p["id"] != "")), F.array().cast("array<struct<provider:string,id:string>>"))
    return rows.select(
        F.col("id").cast("string").alias("external_id"),
        "state",
        F.col("title").alias("canonical_title"),
        va.alternates(F.col("title"), every).alias("alternate_titles"),
        va.kind(F.col("type")).alias("kind"),
        va.series_status(F.col("status")).alias("status"),
        "year",
        va.normal_rating(F.col("rating")).alias("rating"),
        va.parse_count(F.col("final_volume")).alias("total_volumes"),
        va.parse_count(F.col("total_chapters")).alias("total_chapters"),
        F.nullif("description", F.lit("")).alias("description"),
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        foreign.alias("foreign_ids"),
        va.content_hash(*[F.col(c) for c in rows.columns]).alias("metadata_hash"),
    )
