"""HTML listings and detail pages.

Spark reads no HTML, so one Arrow function a page walks it with the standard
parser; everything after the walk is columns.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quillspark.functions import ids
from quillspark.functions.values import parse_size

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LISTING = "array<struct<href:string,title:string,magnet:string,torrent:string,stamp:string,cells:array<string>>>"
DETAIL = "struct<labels:map<string,string>,information_href:string,title:string,stamp:string,torrent:string,files:array<string>,description:string,comments:string>"


class _Walker(HTMLParser):
    """Keeps the stack of open elements; subclasses look at starts, ends and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        self.opened(tag, given)
        if tag not in VOID:
            self.stack.append((tag, given))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self.closed(*self.stack.pop())
                return

    def opened(self, tag, attrs): ...

    def closed(self, tag, attrs): ...


def _has(attrs: dict, name: str) -> bool:
    return name in attrs.get("class", "").split()


class _Listing(_Walker):
    def __init__(self):
        super().__init__()
        self.rows: list[dict] = []
        self.row: dict | None = None
        self.cell: list[str] | None = None
        self.anchor: list[str] | None = None

    def opened(self, tag, attrs):
        if tag == "tr" and any(t == "tbody" for t, _ in self.stack) and any(t == "table" and _has(a, "torrent-list") for t, a in self.stack):
            self.row = {"href": None, "title": None, "magnet": None, "torrent": None, "stamp": None, "cells": []}
        row, href = self.row, attrs.get("href", "")
        if row is None:
            return
        if tag == "a" and href.startswith("/view/") and not _has(attrs, "comments") and row["href"] is None:
            row["href"], row["title"] = href, attrs.get("title")
            self.anchor = []
        elif tag == "a" and href.startswith("magnet:") and row["magnet"] is None:
            row["magnet"] = href
        elif tag == "a" and href.startswith("/download/") and row["torrent"] is None:
            row["torrent"] = href
        elif tag == "td":
            if "data-timestamp" in attrs and row["stamp"] is None:
                row["stamp"] = attrs["data-timestamp"]
            if _has(attrs, "text-center"):
                self.cell = []

    def closed(self, tag, attrs):
        if self.row is None:
            return
        if tag == "a" and self.anchor is not None:
            if self.row["title"] is None:
                self.row["title"] = "".join(self.anchor)
            self.anchor = None
        elif tag == "td" and self.cell is not None:
            self.row["cells"].append("".join(self.cell))
            self.cell = None
        elif tag == "tr":
            self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.anchor is not None:
            self.anchor.append(data)
        if self.cell is not None:
            self.cell.append(data)


class _Detail(_Walker):
    def __init__(self, html: str):
        super().__init__()
        self.out = {"labels": {}, "information_href": None, "title": None, "stamp": None, "torrent": None, "files": [], "description": None, "comments": None}
        self.html, self.lines = html, [0]
        for line in html.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.label: str | None = None
        self.text: list[str] | None = None
        self.reading: tuple[str, int] | None = None
        self.inner: dict[str, tuple[int, int]] = {}
        self.items: list[dict] = []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def opened(self, tag, attrs):
        out, depth = self.out, len(self.stack)
        if "data-timestamp" in attrs and out["stamp"] is None:
            out["stamp"] = attrs["data-timestamp"].strip()
        if tag == "a" and attrs.get("href", "").startswith("/download/") and out["torrent"] is None:
            out["torrent"] = attrs["href"].strip()
        for name in ("torrent-description", "comments"):
            if attrs.get("id") == name and name not in self.inner:
                self.inner[name] = (self._at() + len(self.get_starttag_text() or ""), depth)
        if self.reading is None:
            if tag == "div" and _has(attrs, "col-md-1"):
                self.reading, self.text = ("label", depth), []
            elif self.label is not None:
                self.reading, self.text = ("value", depth), []
            elif tag == "h3" and _has(attrs, "panel-title") and out["title"] is None:
                self.reading, self.text = ("title", depth), []
        elif self.reading[0] == "value" and tag == "a" and self.label == "Information:" and out["information_href"] is None:
            out["information_href"] = attrs.get("href", "").strip()
        if tag == "li" and any(t == "div" and _has(a, "torrent-file-list") for t, a in self.stack):
            self.items.append({"folder": False, "text": [], "depth": depth})
        if tag == "a" and _has(attrs, "folder"):
            for item in self.items:
                item["folder"] = True

    def closed(self, tag, attrs):
        depth, out = len(self.stack), self.out
        for name, key in (("torrent-description", "description"), ("comments", "comments")):
            if name in self.inner and self.inner[name][1] == depth and out[key] is None:
                out[key] = self.html[self.inner[name][0] : self._at()]
        if self.items and self.items[-1]["depth"] == depth:
            item = self.items.pop()
            name = "".join(item["text"]).strip()
            if name and not item["folder"]:
                out["files"].append(name)
        if self.reading and self.reading[1] == depth:
            what, text = self.reading[0], "".join(self.text or []).strip()
            self.reading = self.text = None
            if what == "label":
                self.label = text
            elif what == "value":
                out["labels"].setdefault(self.label, text)
                self.label = None
            elif text:
                out["title"] = text

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)
        if self.items and len(self.stack) == self.items[-1]["depth"] + 1:
            self.items[-1]["text"].append(data)


def _walked(html: Column, schema: str, walk) -> Column:
    kind = to_arrow_type(_parse_datatype_string(schema))  # needs a session, which tasks have none of

    @F.arrow_udf(schema)
    def parse(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else walk(p) for p in pages.to_pylist()], kind)

    return parse(html)


def _listing(page: str) -> list[dict]:
    walker = _Listing()
    walker.feed(page)
    walker.close()
    return walker.rows


def _detail(page: str) -> dict:
    walker = _Detail(page)
    walker.feed(page)
    walker.close()
    return walker.out | {"labels": list(walker.out["labels"].items())}


def parse_listing(pages: DataFrame, source_name: str, base: str, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Releases of listing pages, with the columns to ``keep``; rows without title, id or time are dropped."""
    rows = pages.select(*(keep or []), F.explode(_walked(F.col(html), LISTING, _listing)).alias("r"))
    title = F.trim("r.title")
    id = ids.post_id(F.col("r.href"))
    sizes = F.filter(F.transform("r.cells", parse_size), lambda s: s.isNotNull())
    out = rows.select(
        *(keep or []),
        F.lit("feed").alias("source_kind"),
        F.lit(source_name).alias("source_name"),
        id.alias("external_id"),
        title.alias("title"),
        F.concat(F.lit(base.rstrip("/") + "/view/"), id).alias("link"),
        F.col("r.magnet").alias("magnet"),
        ids.info_hash(F.col("r.magnet")).alias("info_hash"),
        ids.absolute_url(base, F.col("r.torrent")).alias("torrent_url"),
        F.get(sizes, F.lit(0)).alias("size_bytes"),
        F.timestamp_seconds(F.col("r.stamp").try_cast("bigint")).alias("posted_at"),
    )
    return out.where((F.col("title") != "") & F.col("external_id").isNotNull() & F.col("posted_at").isNotNull())


def parse_detail(pages: DataFrame, base: str, html: str = "html") -> DataFrame:
    """Detail fields of pages, beside the other columns; pages without a hash row are dropped.

    Links of the description are the release's own; without a description
    those of the whole page are, less the ones that the comments hold.
    """
    rows = pages.withColumn("_d", _walked(F.col(html), DETAIL, _detail))
    label = lambda name: F.nullif(F.trim(F.try_element_at("_d.labels", F.lit(name))), F.lit(""))
    http = lambda c: F.when(c.rlike("^https?://"), c)
    magnet = F.nullif(F.replace(F.regexp_extract(html, r'href="(magnet:\?[^"]+)"', 1), F.lit("&amp;"), F.lit("&")), F.lit(""))
    comments = ids.harvest_links(F.coalesce("_d.comments", F.lit("")))
    own = F.when(F.col("_d.description").isNotNull(), ids.harvest_links(F.col("_d.description"))).otherwise(ids.subtract_links(ids.harvest_links(F.col(html)), comments))
    return rows.where(label("Info hash:").isNotNull()).select(
        *[c for c in pages.columns if c != html],
        F.lower(label("Info hash:")).alias("info_hash"),
        F.col("_d.title").alias("title"),
        ids.absolute_url(base, F.col("_d.torrent")).alias("torrent_url"),
        parse_size(label("File size:")).alias("size_bytes"),
        F.timestamp_seconds(F.col("_d.stamp").try_cast("bigint")).alias("posted_at"),
        F.col("_d.files").alias("files"),
        magnet.alias("magnet"),
        F.col("_d.description").alias("description_html"),
        comments.alias("comment_suggested_links"),
        own.alias("external_links"),
        F.coalesce(http(F.col("_d.information_href")), http(label("Information:"))).alias("information_url"),
    )
