"""Release rows as they are stored, and as a feed hands them over, both ways.

A stored row holds lists as JSON text, null where a list is empty; a record
holds them as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.spans import SPANS

#: Columns with lists: the stored one, the record's, its type.
LISTS = [
    ("files_json", "files", "array<string>"),
    ("languages_json", "languages", "array<string>"),
    ("volume_span_json", "volume_span", SPANS),
    ("chapter_span_json", "chapter_span", SPANS),
]


def list_of(text: Column, kind: str) -> Column:
    """An array from JSON text; null, blank and unreadable texts are empty lists."""
    read = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(read, lambda x: x.isNotNull()), F.array().cast(kind))


def text_of(values: Column) -> Column:
    """JSON text of an array; null for an empty or null one."""
    return F.when(F.size(values) > 0, F.to_json(values))


def to_record(rows: DataFrame) -> DataFrame:
    """Stored rows as records: lists read, all other columns as they are."""
    stored = {a: (b, kind) for a, b, kind in LISTS}
    return rows.select(*[list_of(F.col(c), stored[c][1]).alias(stored[c][0]) if c in stored else F.col(f"`{c}`") for c in rows.columns])


def to_row(records: DataFrame) -> DataFrame:
    """Records as rows to store: lists written, all other columns as they are."""
    typed = {b: a for a, b, _ in LISTS}
    return records.select(*[text_of(F.col(c)).alias(typed[c]) if c in typed else F.col(f"`{c}`") for c in records.columns])


def gated(rows: DataFrame, columns: list[str], allowed: Column) -> DataFrame:
    """``rows`` whose named columns are null where ``allowed`` is not true."""
    return rows.select(*[F.when(allowed, F.col(c)).alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])
