"""Exports of series as JSON, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.values import cell


def selection(wanted: list[str] | None, known: list[str], always: str = "title") -> list[str]:
    """Known columns that were asked for, in their own order, the title always; none asked for: all."""
    asked = set(wanted or known) | {always}
    chosen = [c for c in known if c in asked]
    return chosen if len(chosen) > 1 or wanted else list(known)


def _cells(rows: DataFrame, columns: list[str]) -> list[Column]:
    kinds = dict(rows.dtypes)
    return [cell(F.col(c), kinds[c]) for c in columns]


def csv_field(text: Column) -> Column:
    """Quoted only where it must be."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_line(rows: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in _cells(rows, columns)])


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")


def markdown_line(rows: DataFrame, columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(c) for c in _cells(rows, columns)]), F.lit(" |"))


def json_line(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV files with a header, CRLF line ends and one line a row."""
    flat = rows.select(*[c.alias(n) for n, c in zip(columns, _cells(rows, columns))])
    flat.write.mode("overwrite").csv(path, header=True, lineSep="\n", quote='"', escape='"', emptyValue="")


def write_json(rows: DataFrame, columns: list[str], path: str, releases: DataFrame | None = None) -> None:
    """JSON lines, with the releases of each series as a nested list if given (``series_id`` and the rest)."""
    if releases is not None:
        rest = [c for c in releases.columns if c != "series_id"]
        nested = releases.groupBy(F.col("series_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("releases"))
        rows, columns = rows.join(nested, "id", "left"), [*columns, "releases"]
    rows.select(*columns).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_markdown(rows: DataFrame, columns: list[str], path: str) -> None:
    """Table rows as text files, the heading in a file of its own before them."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(f"| {' | '.join(columns)} |\n|{'|'.join(' --- ' for _ in columns)}|",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(path)
    rows.select(markdown_line(rows, columns).alias("value")).write.mode("append").text(path)
