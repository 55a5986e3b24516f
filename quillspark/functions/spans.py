"""Coverage intervals ("spans") read from file names and titles, and their algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.bound import let

SPANS = "array<struct<start:double,end:double>>"

# The markers that introduce numbers, and how ranges are written.
GROUPS = r"\([^)]*\)|\[[^\]]*\]"
VOLUME = r"(?i)\bv(?:ol(?:ume)?s?)?\.?\s*(\d+(?:\.\d+)?)(?:[-–](?:v(?:ol(?:ume)?s?)?\.?)?(\d+(?:\.\d+)?)|\s*[-–]\s*v(?:ol(?:ume)?s?)?\.?\s*(\d+(?:\.\d+)?))?"
VOLUME_WORD = r"(?i)\bvol(?:ume)?s?\.?\s+(\d+(?:\.\d+)?)\s*[-–]\s*(?:v(?:ol(?:ume)?s?)?\.?\s*)?(\d+(?:\.\d+)?)"
CHAPTER = r"(?i)(?:\b(?:chapters?|chaps?|ch|c)|#)\.?\s*(\d+(?:\.\d+)?)(?:[-–](?:(?:chapters?|chaps?|ch|c|#)\.?)?(\d+(?:\.\d+)?)|\s*[-–]\s*(?:\b(?:chapters?|chaps?|ch|c)|#)\.?\s*(\d+(?:\.\d+)?))?"
PLUS = r"\+\s*(\d+(?:\.\d+)?)(?:\s*[-–]\s*(\d+(?:\.\d+)?))?"


def without_groups(text: Column) -> Column:
    """Text with its (...) and [...] groups replaced by a space."""
    return F.regexp_replace(text, GROUPS, " ")


def _found(text: Column, pattern: str, groups: int) -> Column:
    """One span for each match: the least and greatest of the numbers it caught."""
    caught = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    first, rest = caught[0], caught[1:]

    def span(head: Column, i: Column) -> Column:
        numbers = [head.try_cast("double"), *[F.get(c, i).try_cast("double") for c in rest]]
        return F.struct(F.least(*numbers).alias("start"), F.greatest(*numbers).alias("end"))

    if not rest:
        return F.transform(first, lambda x: F.struct(x.cast("double").alias("start"), x.cast("double").alias("end")))
    return F.transform(first, span)


def merge_spans(spans: Column) -> Column:
    """Sorted spans with overlapping and adjoining ones joined; gaps stay.

    Inverted spans are turned round.  Two spans join if the next starts at
    most 1 after the end so far.  Null gives null.

    Starts and ends are sorted apart: there is a gap after the first i spans
    exactly if the i-th smallest end is more than 1 below the next start.  A
    single span needs none of that, and most titles have no more.
    """
    return let(spans, _merged)


def _merged(spans: Column) -> Column:
    """:func:`merge_spans` of a bound value."""
    starts = F.array_sort(F.transform(spans, lambda s: F.least(s["start"], s["end"])))
    ends = F.array_sort(F.transform(spans, lambda s: F.greatest(s["start"], s["end"])))

    def joined(x: Column) -> Column:
        a, b = x["starts"], x["ends"]
        opened = F.filter(a, lambda v, i: (i == 0) | (v > F.get(b, i - 1) + 1))
        closed = F.filter(b, lambda v, i: (i == F.size(b) - 1) | (F.get(a, i + 1) > v + 1))
        return F.arrays_zip(opened.alias("start"), closed.alias("end")).cast(SPANS)

    turned = F.transform(spans, lambda s: F.struct(F.least(s["start"], s["end"]).alias("start"), F.greatest(s["start"], s["end"]).alias("end")))
    many = let(F.struct(starts.alias("starts"), ends.alias("ends")), joined)
    return F.when(F.size(spans) <= 1, turned.cast(SPANS)).when(spans.isNotNull(), many)


def detect(text: Column) -> Column:
    """Struct of unmerged ``volumes`` and ``chapters`` of one text."""
    return let(without_groups(text), _of_stem)


def _of_stem(stem: Column) -> Column:
    volumes = F.concat(_found(stem, VOLUME, 3), _found(stem, VOLUME_WORD, 2))
    chapters = F.concat(_found(stem, CHAPTER, 3), _found(stem, PLUS, 2))
    return F.struct(volumes.cast(SPANS).alias("volumes"), chapters.cast(SPANS).alias("chapters"))


def detect_spans(files: Column, title: Column) -> Column:
    """Merged ``volumes`` and ``chapters`` of all file names and the title."""
    texts = F.concat(F.coalesce(files, F.array().cast("array<string>")), F.array(F.coalesce(title, F.lit(""))))

    def merged(found: Column) -> Column:
        volumes = merge_spans(F.flatten(F.transform(found, lambda f: f["volumes"])))
        chapters = merge_spans(F.flatten(F.transform(found, lambda f: f["chapters"])))
        return F.struct(volumes.alias("volumes"), chapters.alias("chapters"))

    return let(F.transform(texts, detect), merged)


def max_end(spans: Column) -> Column:
    """Greatest end, null without spans."""
    return F.array_max(F.transform(spans, lambda s: s["end"]))


def to_json(spans: Column) -> Column:
    """JSON list; null without spans."""
    return F.when(F.size(spans) > 0, F.to_json(spans))


def from_json(text: Column) -> Column:
    """Spans of a JSON list, or of one JSON object as written formerly; anything else is empty."""
    opened = F.substring(F.ltrim(text), 1, 1)
    listed = F.when(opened == "[", F.from_json(text, SPANS))
    single = F.when(opened == "{", F.array(F.from_json(text, "struct<start:double,end:double>")))
    sound = lambda s: s.isNotNull() & s["start"].isNotNull() & s["end"].isNotNull()
    spans = F.coalesce(listed, single)
    return F.when(spans.isNotNull() & F.forall(spans, sound), spans).otherwise(F.array().cast(SPANS))


def number_text(value: Column) -> Column:
    """A double as people write it: whole numbers without ``.0``."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def human(span: Column) -> Column:
    """``5`` or ``1-4``."""
    start, end = number_text(span["start"]), number_text(span["end"])
    return F.when(span["start"] == span["end"], start).otherwise(F.concat(start, F.lit("-"), end))
