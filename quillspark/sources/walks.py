"""Batch walks over listing pages: backfill, keyword search, details anew.

Pages come as a table (one row a page, fetched or on file); how far a walk
reaches is found by aggregation, so all pages are parsed in parallel and those
behind the end are left out afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import merges, paging
from quillspark.sources import pages as listing

#: Most releases whose details are fetched anew in one run.
REENRICH_ROWS = 5000


def reach(pages: DataFrame, found: DataFrame, keys: list[str], page: str = "page", failed: str = "failed") -> DataFrame:
    """``keys`` and ``end``: the first page of a walk that failed or gave no rows; null if none did."""
    counts = found.groupBy(*keys, page).agg(F.count("*").alias("_n"))
    empty = F.coalesce(F.col(failed), F.lit(False)) | F.col("_n").isNull()
    return pages.join(counts, [*keys, page], "left").groupBy(*keys).agg(F.min(F.when(empty, F.col(page))).alias("end"))


def walked(pages: DataFrame, source_name: str, base: str, keys: list[str], limit: int | None = None) -> DataFrame:
    """Releases of the listing pages before each walk's end, each once: that of the lowest page.

    ``pages``: ``keys`` of the walk (a source or a query; none for one walk),
    ``page`` from 1, ``html``, ``failed``.  Pages beyond ``limit`` are not walked.
    """
    pages = pages if limit is None else pages.where(F.col("page") <= max(1, limit))
    found = listing.parse_listing(pages.where(~F.coalesce("failed", F.lit(False))), source_name, base, keep=[*keys, "page"])
    ends = reach(pages, found, keys)
    rows = found.join(ends, keys) if keys else found.crossJoin(F.broadcast(ends))
    rows = rows.where(F.col("end").isNull() | (F.col("page") < F.col("end")))
    return merges.latest(rows.drop("end"), ["source_kind", "external_id"], -F.col("page"), *[F.col(k) for k in keys])


def backfilled(pages: DataFrame, known: DataFrame, source_name: str, base: str, limit: int) -> DataFrame:
    """Releases of a source's older pages that are not stored yet (``known``: ``external_id``)."""
    rows = walked(pages, source_name, base, [], limit).drop("page")
    return rows.join(known.select("external_id"), "external_id", "left_anti")


def searched(pages: DataFrame, source_name: str, base: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Releases that any query of a series finds, each once, and one row on the run.

    The run: ``queries``, ``failed_queries`` (those whose first page failed),
    ``pages``, ``status`` (``error`` if all queries failed, else ``ok``).
    """
    rows = walked(pages, source_name, base, ["query"], limit).drop("page")
    first = pages.where("page = 1").groupBy("query").agg(F.max(F.coalesce("failed", F.lit(False))).alias("_failed"))
    run = first.agg(F.count("*").alias("queries"), F.count_if("_failed").alias("failed_queries"))
    read = pages.where(~F.coalesce("failed", F.lit(False)) & (F.col("page") <= max(1, limit))).agg(F.count("*").alias("pages"))
    status = F.when((F.col("queries") > 0) & (F.col("queries") == F.col("failed_queries")), F.lit("error")).otherwise(F.lit("ok"))
    return rows, run.crossJoin(read).withColumn("status", status)


def to_reenrich(releases: DataFrame, limit: int = REENRICH_ROWS) -> DataFrame:
    """The newest releases whose details are to be fetched anew, with ``batch``: the number of their source.

    Sources are numbered in the order in which they come among those rows.
    """
    chosen = paging.newest(releases, "observed_at", limit).select("id", "source_kind", "source_name", "observed_at")
    order = Window.orderBy(F.col("observed_at").desc(), F.col("id").desc())
    placed = chosen.withColumn("_at", F.row_number().over(order))
    first = placed.groupBy("source_kind", "source_name").agg(F.min("_at").alias("_first"))
    numbered = first.withColumn("batch", F.row_number().over(Window.orderBy("_first"))).drop("_first")
    return placed.join(F.broadcast(numbered), ["source_kind", "source_name"]).drop("_at")
