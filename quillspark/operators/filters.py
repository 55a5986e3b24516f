"""Predicates of the catalog queries, as columns, and the filters that need a join."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.values import QUEUE_STATUSES


def csv_values(text: str | None) -> list[str]:
    """Values of ``a, b,,c``, trimmed, blanks ignored."""
    return [v.strip() for v in (text or "").split(",") if v.strip()]


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of those given; true without any."""
    return functools.reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def csv_filter(column: str, text: str | None) -> Column | None:
    """Equality with one of the listed values; no condition for a blank list."""
    values = csv_values(text)
    return F.col(column).isin(values) if values else None


def flag_filter(column: Column, wanted: bool | None) -> Column | None:
    """Tri-state: true, false or no condition."""
    return None if wanted is None else (column if wanted else ~column)


def present_filter(column: str, wanted: bool | None) -> Column | None:
    """Tri-state on whether a value is there."""
    return flag_filter(F.col(column).isNotNull(), wanted)


def origin_filter(column: str, wanted: str | None) -> Column | None:
    """``manual``: hand-made rows, ``auto``: the others; anything else is no condition."""
    if wanted == "manual":
        return F.col(column) == "manual"
    return F.col(column) != "manual" if wanted == "auto" else None


def status_filter(column: str, wanted: str | None) -> Column:
    """One queue status, or all of them where the name is none of theirs."""
    return F.col(column).isin([wanted] if wanted in QUEUE_STATUSES else QUEUE_STATUSES)


def token_filter(column: str, query: str) -> Column:
    """Every word of the query is in the text, case-insensitively; ``%`` and ``_`` stay wildcards."""
    return all_of(*[F.col(column).ilike(f"%{t}%") for t in query.split()])


def free_text_filter(query: str, link: str = "link", external_id: str = "external_id", title: str = "title") -> Column:
    """A link, with or without a slash at its end; else an external id or the words of a title."""
    query = query.strip()
    if "://" in query:
        bare = query.rstrip("/")
        return F.col(link).isin([bare, bare + "/"])
    return (F.col(external_id) == query) | token_filter(title, query)


def between_times(column: str, since: int, until: int) -> Column:
    """Half-open range."""
    return (F.col(column) >= since) & (F.col(column) < until)


def not_equal_or_null(column: str, value: str) -> Column:
    return F.col(column).isNull() | (F.col(column) != value)


def after_key(stamp: str, id: str, last: tuple[int, int] | None) -> Column:
    """Rows of a change feed behind a key; rows that were never stamped (0) are not in the feed."""
    start = F.col(stamp) > 0
    if last is None:
        return start
    return start & ((F.col(stamp) > last[0]) | ((F.col(stamp) == last[0]) & (F.col(id) > last[1])))


def within_breadth(array: str, value: Column | str, breadth: int) -> Column:
    """Whether a value is among the first entries: one (1), two (2) or all (3 and more) of them."""
    column = F.col(array)
    reach = column if breadth >= 3 else F.slice(column, 1, max(1, breadth))
    return F.coalesce(F.array_contains(reach, value), F.lit(False))


def active_filter(column: str = "state") -> Column:
    return F.col(column).isNull() | (F.col(column) == "active")


def stale_filter(source: str, fetched: str, now: int, age: int) -> Column:
    """Rows not made by hand whose data are older than ``age`` seconds; a negative age counts as 0."""
    return (F.col(source) != "manual") & (F.col(fetched) < max(0, now - max(0, age)))


def only_ids(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``ids`` (none for an empty set)."""
    return df.join(ids.select(*on), on, "left_semi")


def except_ids(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in ``ids`` (all for an empty set); null keys stay."""
    return df.join(ids.select(*on), on, "left_anti")
