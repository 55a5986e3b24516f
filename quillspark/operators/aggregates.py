"""Run summaries, time buckets, nearest-rank percentiles, tallies, coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import spans
from quillspark.operators.lineage import settled


def success_rate(ok: Column, failed: Column) -> Column:
    """Share of successes among runs that ended; null without any."""
    return F.when(ok + failed > 0, ok / (ok + failed))


def run_summary(runs: DataFrame, key: str, counters: list[str], since: int, until: int) -> DataFrame:
    """Per ``key``: runs, successes, failures, skips, sums of counters, last start and its status.

    The last status is that of the latest start, of equal ones the greater id.
    One aggregation: ``max_by`` replaces the window and join.
    """
    rows = runs.where((F.col("started_at") >= since) & (F.col("started_at") < until))
    count = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy(key).agg(
        F.count("*").alias("runs"),
        count("success").alias("successes"),
        count("failure").alias("failures"),
        count("skipped").alias("skips"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum") for c in counters],
        F.max("started_at").alias("last_started_at"),
        F.max_by("status", F.struct("started_at", "id")).alias("last_status"),
    )
    return out.withColumn("success_rate", success_rate(F.col("successes"), F.col("failures")))


def time_buckets(runs: DataFrame, keys: list[str], since: int, until: int, width: int, *aggregates: Column) -> DataFrame:
    """Tumbling buckets of ``width`` seconds that begin at ``since``; empty ones are not there."""
    start = F.expr(f"((started_at - {since}) div {width}) * {width} + {since}")
    rows = runs.where((F.col("started_at") >= since) & (F.col("started_at") < until))
    return rows.groupBy(*keys, start.alias("bucket_start")).agg(*aggregates)


def histogram(rows: DataFrame, key: str) -> DataFrame:
    """Rows by value, null as a value of its own."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], keys: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """Nearest-rank percentiles at rank floor(p n + 0.5), with count and maximum.

    Values are counted first, on the map side, then summed by bucket.  Borders
    are approximate percentiles of a group's different values, so that an
    outlier does not gather the others in one bucket, and each cell between two
    borders has equal steps, as many as there are cells.  They are settled, as
    another run could draw them elsewhere and the buckets that are counted have
    to be those that are searched.  Only the values of the one bucket that holds a
    rank are ordered, so no task sees all the values of a group, or of a table
    without ``keys``.  Without keys and values: one row, n = 0.
    """
    keys, steps = keys or [], max(1, math.isqrt(buckets))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cuts = F.percentile_approx(F.col(value).cast("double"), [i / steps for i in range(steps + 1)], 1000)
    ends = settled(counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.max(value).alias("max"), cuts.alias("_cuts")))
    joined = (counts.join(ends, keys) if keys else counts.crossJoin(F.broadcast(ends))).withColumn("_v", F.col(value).cast("double"))
    cell = F.size(F.filter("_cuts", lambda x: x <= F.col("_v")))
    placed = joined.withColumn("_cell", cell)
    low, high = F.get("_cuts", F.col("_cell") - 1), F.get("_cuts", F.col("_cell"))
    step = F.when((F.col("_cell") > 0) & (high > low), F.least(F.floor((F.col("_v") - low) / (high - low) * steps), F.lit(steps - 1))).otherwise(0)
    placed = placed.withColumn("_b", (F.col("_cell") * steps + step).cast("int"))
    sums = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"), F.first("_n").alias("_n"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = sums.withColumn("_before", F.sum("_s").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"))
    rank = lambda p: F.greatest(F.floor(F.lit(float(p)) * F.col("_n") + 0.5), F.lit(1))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(p).alias("rank")) for name, p in shares.items()])
    held = before.select(*keys, "_b", "_before", "_s", F.explode(wanted).alias("_w")).where((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_s")))
    within = placed.select(*keys, "_b", value, "_c").join(F.broadcast(held) if not keys else held, [*keys, "_b"])
    inside = Window.partitionBy(*keys, "_w.name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = within.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside)).where(F.col("_upto") >= F.col("_w.rank"))
    picks = [F.min(F.when(F.col("_w.name") == name, F.col(value))).alias(name) for name in shares]
    picked = found.groupBy(*keys).agg(*picks)
    whole = ends.select(*keys, F.coalesce("_n", F.lit(0).cast("bigint")).alias("n"), "max")
    out = whole.join(picked, keys) if keys else whole.crossJoin(F.broadcast(picked))
    return out.select(*keys, "n", *shares, "max")


def counts_by_status(rows: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """One row: total (of all statuses) and a count for each named one."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def outcome_tally(rows: DataFrame) -> DataFrame:
    """Resolution outcomes: by path where resolved, else review or failed."""
    path, status = F.col("resolution_path"), F.col("resolution_status")
    done = status == "resolved"
    return rows.agg(
        F.count_if(done & (path == "known_external_id")).alias("known_id"),
        F.count_if(done & (path == "foreign_id_lookup")).alias("foreign_id"),
        F.count_if(done & (path == "fuzzy_title")).alias("fuzzy"),
        F.count_if(status.isin("review_pending", "ambiguous")).alias("review"),
        F.count_if(~done & ~status.isin("review_pending", "ambiguous")).alias("failed"),
    )


def retry_tally(rows: DataFrame) -> DataFrame:
    """Outcomes of a batch that was resolved anew: one row of six counters.

    ``rows``: ``resolution_status``, ``skipped`` (an operator's decision was
    left alone), ``failed``.  A failure counts as nothing else, a skip as no status.
    """
    status = F.when(F.coalesce("failed", F.lit(False)), F.lit("error")).when(F.coalesce("skipped", F.lit(False)) | F.col("resolution_status").isin("rejected", "standalone"), F.lit("skip")).otherwise(F.col("resolution_status"))
    names = {"resolved": "resolved", "ambiguous": "ambiguous", "review_pending": "review_pending", "unresolved": "unresolved", "skip": "skipped", "error": "errors"}
    return rows.agg(*[F.count_if(status == k).alias(v) for k, v in names.items()])


def groups_over(rows: DataFrame, array: str, id: str, breadth: int, least: int = 2) -> DataFrame:
    """Values among the first entries of an array, with the number of rows that hold them, ``least`` or more."""
    reach = F.col(array) if breadth >= 3 else F.slice(array, 1, max(1, breadth))
    items = rows.select(F.col(id).alias("_id"), F.explode(reach).alias("value")).distinct()
    return items.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def dominant_candidate(rows: DataFrame, candidates: DataFrame, array: str, breadth: int) -> DataFrame:
    """For each value among the first entries the candidate most rows have; then the higher score sum, the smaller id."""
    reach = F.col(array) if breadth >= 3 else F.slice(array, 1, max(1, breadth))
    items = rows.select(F.col("id").alias("release_id"), F.explode(reach).alias("value")).distinct()
    found = items.join(candidates, "release_id").groupBy("value", "series_id").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"))
    best = found.groupBy("value").agg(F.max(F.struct("n", "score_sum", (-F.col("series_id")).alias("neg"))).alias("b"))
    return best.select("value", (-F.col("b.neg")).alias("series_id"), F.col("b.n").alias("n"), F.col("b.score_sum").alias("score_sum"))


def with_derived_spans(releases: DataFrame) -> DataFrame:
    """``releases`` whose spans are both null get those that their files and title name; others stay."""
    bare = F.col("volume_span").isNull() & F.col("chapter_span").isNull()
    found = releases.withColumn("_found", F.when(bare, spans.detect_spans(F.col("files"), F.col("title"))))
    out = found.withColumn("volume_span", F.coalesce("volume_span", "_found.volumes")).withColumn("chapter_span", F.coalesce("chapter_span", "_found.chapters"))
    return out.drop("_found")


#: Unit cells of one block: no group gathers more.
BLOCK = 1024


def union_of_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``spans``: the merged spans of rows with ``start`` and ``end``; adjoining ones join as in ``spans.merge_spans``.

    Spans that start within one unit always join, so a least start and a
    greatest end stand for all of them, combined on the map side.  Those are
    merged within blocks of neighbouring units, and what is left of the blocks
    is merged at last: a group never holds more than :data:`BLOCK` spans, or
    the result's own.
    """
    low, high = F.least("start", "end"), F.greatest("start", "end")
    cells = rows.groupBy(*keys, F.floor(low).cast("bigint").alias("_cell")).agg(F.min(low).alias("start"), F.max(high).alias("end"))
    gathered = F.collect_list(F.struct("start", "end"))
    blocks = cells.groupBy(*keys, F.expr(f"_cell div {BLOCK}").alias("_block")).agg(spans.merge_spans(gathered.cast(spans.SPANS)).alias("spans"))
    return blocks.groupBy(*keys).agg(spans.merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"))


def coverage(releases: DataFrame) -> DataFrame:
    """Per series the merged volume and chapter spans of its releases, their ends, and last times."""
    rows = releases.where(F.col("series_id").isNotNull())
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_span").cast(spans.SPANS).alias("spans")) for k in ("volume", "chapter")])
    each = rows.select("series_id", F.explode(kinds).alias("k")).select("series_id", "k.kind", F.explode("k.spans").alias("s")).select("series_id", "kind", "s.start", "s.end")
    union = union_of_spans(each, ["series_id", "kind"])
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("spans")))
    found = union.groupBy("series_id").agg(of("volume").alias("volumes"), of("chapter").alias("chapters"))
    times = rows.groupBy("series_id").agg(F.max("observed_at").alias("last_discovered_at"), F.max("posted_at").alias("last_release_at"))
    out = times.join(found, "series_id", "left")
    empty = F.array().cast(spans.SPANS)
    out = out.select("series_id", F.coalesce("volumes", empty).alias("volumes"), F.coalesce("chapters", empty).alias("chapters"), "last_discovered_at", "last_release_at")
    return out.withColumn("highest_volume", spans.max_end(F.col("volumes"))).withColumn("highest_chapter", spans.max_end(F.col("chapters")))


def rewritten_spans(releases: DataFrame) -> DataFrame:
    """``releases`` with spans anew from files and title (null where there are none), and ``rewritten`` where they differ."""
    found = releases.withColumn("_found", spans.detect_spans(F.col("files"), F.col("title")))
    new = {k: F.when(F.size(F.col("_found").getField(f"{k}s")) > 0, F.col("_found").getField(f"{k}s")) for k in ("volume", "chapter")}
    same = new["volume"].eqNullSafe(F.col("volume_span").cast(spans.SPANS)) & new["chapter"].eqNullSafe(F.col("chapter_span").cast(spans.SPANS))
    return found.withColumn("rewritten", ~same).withColumn("volume_span", new["volume"]).withColumn("chapter_span", new["chapter"]).drop("_found")


def rewrite_counts(releases: DataFrame, series: DataFrame) -> DataFrame:
    """One row: releases read and rewritten, series read and changed, of :func:`rewritten_spans` and :func:`recompute_coverage`."""
    of_releases = releases.agg(F.count("*").alias("releases_read"), F.count_if("rewritten").alias("releases_rewritten"))
    return of_releases.crossJoin(F.broadcast(series.agg(F.count("*").alias("series_read"), F.count_if("changed").alias("series_changed"))))


def recompute_coverage(series: DataFrame, releases: DataFrame, now: int) -> DataFrame:
    """``series`` (``id`` and the coverage columns) with coverage anew and ``changed``.

    Series without releases get empty coverage, a last release of 0 and no
    time of discovery.  The update stamp moves only if spans or ends changed,
    not for discovery times.
    """
    made = coverage(releases)
    empty = F.array().cast(spans.SPANS)
    old = series.select("id", F.col("volumes").alias("_v"), F.col("chapters").alias("_c"), "updated_at")
    rows = old.join(made.withColumnRenamed("series_id", "id"), "id", "left")
    rows = rows.withColumn("volumes", F.coalesce("volumes", empty)).withColumn("chapters", F.coalesce("chapters", empty))
    changed = ~(F.col("volumes").eqNullSafe(F.coalesce("_v", empty)) & F.col("chapters").eqNullSafe(F.coalesce("_c", empty)))
    released = F.coalesce("last_release_at", F.lit(0).cast("bigint")).alias("last_release_at")
    return rows.select("id", "volumes", "chapters", "highest_volume", "highest_chapter", "last_discovered_at", released, changed.alias("changed"), F.when(changed, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")).alias("updated_at"))
