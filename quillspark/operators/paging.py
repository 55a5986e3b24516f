"""Sorting, pages and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.ids import cursor
from quillspark.operators.filters import after_key
from quillspark.operators.lineage import settled

#: Page sizes: of lists and of the change feed.
DEFAULT_SIZE, MAX_SIZE = 50, 200
FEED_SIZE, FEED_MAX = 100, 500


def page_bounds(page: int | None, size: int | None) -> tuple[int, int]:
    """Offset and limit; pages count from 1, sizes are clamped."""
    size = min(max(size or DEFAULT_SIZE, 1), MAX_SIZE)
    return (max(page or 1, 1) - 1) * size, size


def nulls_last(column: str, ascending: bool = False) -> Column:
    return F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()


def sorted_by(df: DataFrame, wanted: str | None, allowed: list[str], default: str, direction: str | None, id: str = "id") -> DataFrame:
    """By an allowed column, else the default one; descending unless ``asc``; nulls last; ties by id."""
    column = wanted if wanted in allowed else default
    return df.orderBy(nulls_last(column, direction == "asc"), F.col(id).asc())


def page_of(df: DataFrame, page: int | None, size: int | None) -> DataFrame:
    offset, limit = page_bounds(page, size)
    return df.offset(offset).limit(limit)


def feed_page(df: DataFrame, last: tuple[int, int] | None, limit: int | None, stamp: str = "updated_at", id: str = "id") -> DataFrame:
    """Next page of a change feed, with each row's ``cursor`` and ``has_more`` of the page."""
    limit = min(max(limit or FEED_SIZE, 1), FEED_MAX)
    rows = df.where(after_key(stamp, id, last)).orderBy(F.col(stamp).asc(), F.col(id).asc()).limit(limit + 1)
    place = Window.orderBy(F.col(stamp).asc(), F.col(id).asc())
    numbered = rows.withColumn("_n", F.row_number().over(place)).withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(0))) > limit)
    return numbered.where(F.col("_n") <= limit).withColumn("cursor", cursor(F.col(stamp), F.col(id))).drop("_n")


def newest(df: DataFrame, column: str, n: int, id: str = "id") -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(id).desc()).limit(n)


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """First n rows of each group; the rank limit is applied before the shuffle, too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def reranked(df: DataFrame, rough: Column, pool: int, score: Column, n: int, id: str = "id") -> DataFrame:
    """The n best by ``score`` of the ``pool`` best by a rough one; ties keep the rough order."""
    first = df.withColumn("_rough", rough).orderBy(F.col("_rough").desc(), F.col(id)).limit(pool)
    return first.withColumn("score", score).orderBy(F.col("score").desc(), F.col("_rough").desc(), F.col(id)).limit(n).drop("_rough")


def ranked_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``rows`` with ``rank`` and the ``total`` of all rows; ``order`` ends in a key.

    Rows are sorted by ranges, and the counts of the ranges give the rank that
    each one begins with; one number for each range reaches the driver.  Only
    the ranges that the page lies in are numbered, so a late page costs as much
    as the first.  ``rows`` should be narrow: what is shown is joined to the page.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dict(map(tuple, ranged.groupBy("_part").count().collect()))
    total, first, last = sum(counts.values()), (page - 1) * size, page * size
    before, begins = 0, []
    for part, n in sorted(counts.items()):
        if before < last and before + n > first:
            begins.append((part, before))
        before += n
    within = ranged.where(F.col("_part").isin([p for p, _ in begins]) if begins else F.lit(False))
    start = F.lit(0)
    for part, n in begins:
        start = F.when(F.col("_part") == part, F.lit(n)).otherwise(start)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + start)
    return ranked.where((F.col("rank") > first) & (F.col("rank") <= last)).withColumn("total", F.lit(total).cast("bigint")).drop("_part")
