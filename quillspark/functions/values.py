"""Sizes, dates, counts, ratings, vocabularies, states and export cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of sizes, vocabularies, error words.
UNITS = {"b": 1.0, "kib": 1024.0, "kb": 1e3, "mib": 1024.0**2, "mb": 1e6, "gib": 1024.0**3, "gb": 1e9, "tib": 1024.0**4, "tb": 1e12}
KINDS = {"manga": "manga", "manhwa": "manhwa", "manhua": "manhua", "novel": "novel", "one_shot": "one_shot", "oneshot": "one_shot", "oel": "oel"}
STATUSES = {"releasing": "ongoing", "ongoing": "ongoing", "completed": "completed", "hiatus": "hiatus", "cancelled": "cancelled", "upcoming": "upcoming"}
ERROR_WORDS = [
    (["timed out", "dns error", "connection refused", "connect error", "tcp connect", "tls handshake"], "network"),
    (["status: 4", "status: 5"], "http_status"),
    (["parse", "invalid", "decode"], "parse"),
]
QUEUE_STATUSES = ["unresolved", "ambiguous", "review_pending"]
ALL_STATUSES = ["resolved", "unresolved", "ambiguous", "review_pending", "rejected", "standalone"]


#: Seconds of a unit; the range without one, its bounds; the number of buckets without one, its bounds.
RANGE_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
DEFAULT_RANGE, LEAST_RANGE, MOST_RANGE = 24 * 3600, 60, 90 * 86400
DEFAULT_BUCKETS, LEAST_BUCKETS, MOST_BUCKETS = 24, 4, 168


def range_seconds(text: Column) -> Column:
    """Seconds of a range as ``24h`` or ``7d``, within a minute and 90 days; 24 hours for null and anything else."""
    said = F.trim(text)
    number = F.regexp_extract(said, r"^([+-]?[0-9]+)[A-Za-z]$", 1).try_cast("bigint")
    unit, size = F.lower(F.right(said, F.lit(1))), F.lit(None).cast("bigint")
    for name, seconds in RANGE_UNITS.items():
        size = F.when(unit == name, F.lit(seconds).cast("bigint")).otherwise(size)
    seconds = F.try_multiply(number, size)
    return F.when(seconds.isNull(), F.lit(DEFAULT_RANGE)).otherwise(F.least(F.greatest(seconds, F.lit(LEAST_RANGE)), F.lit(MOST_RANGE))).cast("bigint")


def bucket_width(seconds: Column, buckets: Column) -> Column:
    """Seconds of a bucket, rounded up, for a number of buckets brought within its bounds."""
    number = F.least(F.greatest(F.coalesce(buckets, F.lit(DEFAULT_BUCKETS)), F.lit(LEAST_BUCKETS)), F.lit(MOST_BUCKETS))
    return F.ceil(seconds / number).cast("bigint")


def parse_size(text: Column) -> Column:
    """Bytes of ``1,234.5 MiB``; null for anything else."""
    number = F.replace(F.regexp_extract(F.trim(text), r"^(.*) (\S+)$", 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(F.trim(text), r"^(.*) (\S+)$", 2))
    factor = F.lit(None).cast("double")
    for name, size in UNITS.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    return F.floor(number * factor).cast("bigint")


def parse_mail_date(text: Column) -> Column:
    """Timestamp of an RFC 2822 date, with or without the day's name; null if it is none."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"(?:GMT|UTC|UT|Z)$", "+0000")
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))


def parse_count(text: Column) -> Column:
    """Whole number; a decimal one is truncated; else null."""
    text = F.trim(text)
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("int"), F.when(~F.isnan(number), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("int")))


def normal_rating(rating: Column) -> Column:
    """0..100 as 0..10; anything else is null."""
    return F.when(~F.isnan(rating) & rating.between(0, 100), rating / 10)


def _mapped(text: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for key, value in table.items():
        out = F.when(text == key, F.lit(value)).otherwise(out)
    return F.when(text.isNotNull(), out)


def kind(text: Column) -> Column:
    """Kind by vocabulary; unknown words stay."""
    return _mapped(text, KINDS, text)


def series_status(text: Column) -> Column:
    """State by vocabulary; unknown words are ``unknown``."""
    return F.coalesce(_mapped(text, STATUSES, F.lit("unknown")), F.lit("unknown"))


def presence(ignored: Column, volume: Column, chapter: Column, have_volume: Column, have_chapter: Column) -> Column:
    """State of a library copy against what was discovered.

    Ignored; behind if a comparable axis is lower; complete if one compares;
    present if something is tracked on an axis the library has not; complete.
    """
    behind = F.coalesce(have_volume < volume, F.lit(False)) | F.coalesce(have_chapter < chapter, F.lit(False))
    comparable = (volume.isNotNull() & have_volume.isNotNull()) | (chapter.isNotNull() & have_chapter.isNotNull())
    tracked = volume.isNotNull() | chapter.isNotNull()
    return F.when(ignored, F.lit("ignored")).when(behind, F.lit("behind")).when(comparable, F.lit("complete")).when(tracked, F.lit("present")).otherwise(F.lit("complete"))


def error_class(message: Column) -> Column:
    """Class of an error message, by the first group of words of which it holds one."""
    out = F.lit("internal")
    for words, name in reversed(ERROR_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(message, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(message.isNotNull(), out)


def first_cover(*urls: Column) -> Column:
    """First of the given columns that is not null or empty."""
    return F.coalesce(*[F.nullif(u, F.lit("")) for u in urls])


def alternates(canonical: Column, titles: Column) -> Column:
    """Distinct titles in order, without blanks and the canonical one."""
    return F.array_distinct(F.filter(titles, lambda t: t.isNotNull() & (t != "") & ~t.eqNullSafe(canonical)))


def foreign_ids(columns: dict[str, Column]) -> Column:
    """Array of ``provider``, ``id`` of the columns that hold one, in the given order."""
    rows = F.array(*[F.struct(F.lit(p).alias("provider"), c.cast("string").alias("id")) for p, c in columns.items()])
    return F.filter(rows, lambda r: r["id"].isNotNull() & (r["id"] != ""))


def content_hash(*columns: Column) -> Column:
    """Hash of a row's content as canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns)), 256))


def names_once(names: Column) -> Column:
    """Trimmed names without blanks; of names that differ in case the first."""
    neat = F.filter(F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.trim(n)), lambda n: n != "")
    lowered = F.transform(neat, lambda n: F.lower(n))
    return F.filter(neat, lambda n, i: F.array_position(lowered, F.lower(n)) == i + 1)


def cell(value: Column, kind: str) -> Column:
    """Export cell: lists joined by ``; ``, true/false, whole doubles without ``.0``, null blank."""
    if kind.startswith("array"):
        text = F.array_join(value.cast("array<string>"), "; ")
    elif kind == "double":
        text = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def reason(score: Column) -> Column:
    """Why a candidate was put up: ``fuzzy_title:0.712``."""
    return F.format_string("fuzzy_title:%.3f", F.bround(score.cast("double"), 3))
