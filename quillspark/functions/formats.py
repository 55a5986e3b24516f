"""File formats of a release and their agreement with the kind of an entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in their order; extensions that are no format.
FORMATS = ["cbz", "cbr", "cb7", "cbt", "zip", "rar", "7z", "tar", "epub", "pdf", "mobi", "azw3", "m4b", "mp3", "m4a", "flac"]
NOISE = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "txt", "md", "nfo", "sfv", "url", "log", "json", "xml", "yml", "yaml", "db", "ds_store"]
#: Default rules: files of these formats need an entity of one of these kinds.
RULES = [
    (["cbz", "cbr", "zip", "rar"], ["manga", "manhwa", "manhua", "one_shot", "oel"]),
    (["epub", "azw3", "mobi", "m4b", "mp3", "m4a", "flac", "audiobook"], ["novel"]),
]


def extension(path: Column) -> Column:
    """Lower-case extension of the last path part; none for names that only begin with a dot."""
    name = F.regexp_extract(F.trim(path), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def detect_formats(files: Column) -> Column:
    """Distinct formats: the known ones in their order, others after them by name."""
    found = F.array_distinct(F.filter(F.transform(F.coalesce(files, F.array().cast("array<string>")), extension), lambda e: (e != "") & ~e.isin(NOISE)))
    known = F.filter(F.array(*[F.lit(f) for f in FORMATS]), lambda f: F.array_contains(found, f))
    return F.concat(known, F.array_sort(F.array_except(found, F.array(*[F.lit(f) for f in FORMATS]))))


def title_hints(title: Column) -> Column:
    """``audiobook`` if the title says so as a whole word."""
    said = title.rlike(r"(?i)(?:^|[^\p{IsAlphabetic}\p{N}])audiobooks?(?:$|[^\p{IsAlphabetic}\p{N}])")
    return F.when(said, F.array(F.lit("audiobook"))).otherwise(F.array().cast("array<string>"))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _lowered(values: Column) -> Column:
    return F.transform(values, lambda v: F.lower(v))


def mismatch(formats: Column, kind: Column, rules: list[tuple[list[str], list[str]]] = RULES) -> Column:
    """First rule that the formats set off and the kind breaks: struct of ``formats`` and ``kinds``; null if none.

    An unknown (null) kind breaks no rule; case does not matter.
    """
    have = _lowered(formats)
    out = F.lit(None).cast("struct<formats:array<string>,kinds:array<string>>")
    for wanted, kinds in reversed(rules):
        hit = F.array_intersect(_strings([w.lower() for w in wanted]), have)
        broken = (F.size(hit) > 0) & ~F.array_contains(_strings([k.lower() for k in kinds]), F.lower(kind))
        out = F.when(kind.isNotNull() & broken, F.struct(hit.alias("formats"), _strings(kinds).alias("kinds"))).otherwise(out)
    return out


def fired_rules(formats: Column, rules: list[tuple[list[str], list[str]]] = RULES) -> Column:
    """Numbers of the rules that the formats set off, ascending."""
    have = _lowered(formats)
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(_strings([w.lower() for w in wanted]), have), F.lit(i)) for i, (wanted, _) in enumerate(rules)]))


def allowed_kinds(formats: Column, rules: list[tuple[list[str], list[str]]] = RULES) -> Column:
    """Distinct kinds that some fired rule allows; empty if none fired."""
    fired = fired_rules(formats, rules)
    table = F.array(*[_strings([k.lower() for k in kinds]) for _, kinds in rules])
    return F.array_distinct(F.flatten(F.transform(fired, lambda i: F.get(table, i))))


def compatible(formats: Column, kind: Column, rules: list[tuple[list[str], list[str]]] = RULES) -> Column:
    """Whether a kind agrees with the fired rules; unknown kinds and unconstrained formats do."""
    allowed = allowed_kinds(formats, rules)
    return kind.isNull() | (F.size(allowed) == 0) | F.array_contains(allowed, F.lower(kind))


def kind_buckets(formats: Column, kind: Column, rules: list[tuple[list[str], list[str]]] = RULES) -> Column:
    """Numbers of the fired rules that allow the kind; none for an unknown kind."""
    table = F.array(*[_strings([k.lower() for k in kinds]) for _, kinds in rules])
    fits = F.filter(fired_rules(formats, rules), lambda i: F.array_contains(F.get(table, i), F.lower(kind)))
    return F.when(kind.isNull(), F.array().cast("array<int>")).otherwise(fits)
