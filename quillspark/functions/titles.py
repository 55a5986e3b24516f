"""Search queries from noisy release titles: strip rules, alternates, fallbacks, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.bound import let

QUERY = "array<struct<text:string,weight:float>>"
FALLBACK_WEIGHT = 0.9

# The words and patterns that are stripped, in this order.
FORMAT_WORDS = ["Digital", "Raw", "Color", "Colored", "Omnibus", "Premium", "Complete", "Decensored", "Uncensored", "Webtoon", "WN", "LN"]
STRIP_RULES = [
    ("strip_brackets", r"\[[^\]]*\]"),
    ("strip_parens", r"\([^)]*\)"),
    ("strip_braces", r"\{[^}]*\}"),
    ("strip_vol_compact", r"(?i)\b(?:v|vol\.?|c|ch\.?)\s*\d{1,4}(?:\.\d{1,2})?(?:v\d+)?(?:\s*[-+,&]\s*\d{1,4}(?:\.\d{1,2})?)*\b"),
    ("strip_vol_word", r"(?i)\b(?:volumes?|chapters?)\s+\d{1,4}(?:\.\d{1,2})?(?:v\d+)?(?:\s*[-–]\s*\d{1,4}(?:\.\d{1,2})?)?\b"),
    ("strip_parts", r"(?i)\bparts\s+\d{1,4}(?:\s*[-–]\s*\d{1,4})?\b"),
    ("strip_chapter_range", r"(?i)\b\d{1,4}(?:\.\d{1,2})?\s*-\s*\d{1,4}(?:\.\d{1,2})?(?:\s+as\b)?"),
    ("strip_year", r"\b(?:19|20)\d{2}\b"),
    ("strip_ext", r"(?i)\.(?:zip|cbz|cbr|epub|pdf|rar|7z)\b"),
]
CHAPTER_SUFFIX = r"\s+(?:\d+\.\d+|0\d+|\d{3,})\s*$"
ALTERNATES = r"\s*\|\s*|\s+/\s+"
_META = set("\\.*+?[](){}|^$")


def check_keyword(word: str) -> str:
    """An extra format word as given; blank ones and regular-expression marks are refused."""
    if not word.strip():
        raise ValueError("a format keyword must not be blank")
    if bad := next((c for c in word if c in _META), None):
        raise ValueError(f"format keyword {word!r} holds the mark {bad!r}; use plain words")
    return word


def strip_rules(extra_words: list[str] | None = None) -> list[tuple[str, str]]:
    words = [*FORMAT_WORDS, *[check_keyword(w) for w in extra_words or []]]
    return [*STRIP_RULES, ("strip_format", rf"(?i)\b(?:{'|'.join(words)})\b")]


def squeezed(text: Column) -> Column:
    """White space collapsed; white space and ``-,_/|+`` trimmed at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[\s\-,_/|+]+|[\s\-,_/|+]+$", "")


def _append_new(queries: Column, heads: Column) -> Column:
    """Queries plus the heads that are no query yet, discounted, each once."""
    known = F.transform(queries, lambda q: q["text"])
    fresh = F.array_except(heads, known)
    return F.concat(queries, F.transform(fresh, lambda h: F.struct(h.alias("text"), F.lit(FALLBACK_WEIGHT).cast("float").alias("weight"))))


def clean_title(title: Column, extra_words: list[str] | None = None) -> Column:
    """Struct ``queries`` (texts with weights, longest first) and ``rules`` (names of those that applied).

    Length is that in UTF-8 bytes and equal lengths keep their order.  A title
    of which nothing is left is its own query.
    """
    steps = [F.coalesce(title, F.lit(""))]
    names = []
    for name, pattern in strip_rules(extra_words):
        steps.append(F.regexp_replace(steps[-1], pattern, " "))
        names.append(F.when(steps[-1] != steps[-2], F.lit(name)))
    stripped = steps[-1]
    several = F.contains(stripped, F.lit("|")) | F.contains(stripped, F.lit(" / "))
    halves = F.filter(F.transform(F.when(several, F.split(stripped, ALTERNATES)).otherwise(F.array(stripped)), squeezed), lambda h: h != "")

    def from_halves(parts: Column) -> Column:
        whole = F.transform(parts, lambda t: F.struct(t.alias("text"), F.lit(1.0).cast("float").alias("weight")))
        long = lambda h: F.char_length(h) >= 2
        heads = F.filter(F.transform(F.filter(parts, lambda t: F.contains(t, F.lit(" - "))), lambda t: F.trim(F.substring_index(t, " - ", 1))), long)

        def with_heads(queries: Column) -> Column:
            texts = F.transform(queries, lambda q: q["text"])
            cut = F.filter(F.transform(F.filter(texts, lambda t: t.rlike(CHAPTER_SUFFIX)), lambda t: F.trim(F.regexp_replace(t, CHAPTER_SUFFIX, ""))), long)

            def done(every: Column) -> Column:
                final = F.when(F.size(every) > 0, every).otherwise(F.array(F.struct(F.coalesce(title, F.lit("")).alias("text"), F.lit(1.0).cast("float").alias("weight"))))
                placed = F.transform(final, lambda q, i: F.struct((-F.octet_length(q["text"])).alias("size"), i.alias("at"), q["text"].alias("text"), q["weight"].alias("weight")))
                ordered = F.transform(F.array_sort(placed), lambda q: F.struct(q["text"].alias("text"), q["weight"].alias("weight")))
                rules = F.array(
                    *names,
                    F.when(several & (F.size(parts) > 1), F.lit("split_alternates")),
                    F.when(F.size(queries) > F.size(parts), F.lit("split_subtitle")),
                    F.when(F.size(every) > F.size(queries), F.lit("split_chapter_suffix")),
                    F.when(F.size(every) == 0, F.lit("empty_fallback")),
                )
                return F.struct(ordered.cast(QUERY).alias("queries"), F.array_compact(rules).alias("rules"))

            return let(_append_new(queries, cut), done)

        return let(_append_new(whole, heads), with_heads)

    return let(halves, from_halves)


def primary(cleaned: Column) -> Column:
    """The leading query."""
    return F.get(cleaned["queries"], F.lit(0))["text"]


def query_set(titles: Column, limit: int = 12) -> Column:
    """Struct ``queries`` and ``dropped`` for searching an entity by all its titles.

    White space is normalised; ASCII titles need three characters, others
    two; titles that differ only in case count once, the first stays.
    """
    neat = F.transform(F.filter(titles, lambda t: t.isNotNull()), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    enough = lambda t: F.char_length(t) >= F.when(F.octet_length(t) == F.char_length(t), 3).otherwise(2)
    paired = F.transform(F.filter(neat, enough), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))

    def once(pairs: Column) -> Column:
        return let(F.transform(pairs, lambda p: p["low"]), lambda lows: F.filter(pairs, lambda p, i: F.array_position(lows, p["low"]) == i + 1))

    def cut(kept: Column) -> Column:
        queries = F.transform(F.slice(kept, 1, limit), lambda p: p["text"])
        return F.struct(queries.alias("queries"), F.greatest(F.size(kept) - limit, F.lit(0)).alias("dropped"))

    return let(let(paired, once), cut)
