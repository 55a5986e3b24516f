"""Streaming jobs: polling feeds, late details, the change feed, windowed run counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import aggregates, merges, paging
from quillspark.operators.filters import between_times
from quillspark.operators.lineage import settled
from quillspark.sources import feeds
from quillspark.sources.tables import Change, TableSet, kept_first, replaced

#: Late details: rows a tick, seconds back.
LATE_ROWS, LATE_WINDOW = 5, 72 * 3600
#: Columns of a release that each sighting brings, and those that it may lack.
SIGHTED = ["title", "link", "magnet", "torrent_url", "info_hash", "size_bytes", "posted_at"]
DETAILED = ["files", "description_html", "external_links"]
KEY = ["source_kind", "external_id"]
RUN = "run string, source_name string, started_at bigint, finished_at bigint, status string, fetched bigint, unmodified bigint, broken bigint, new bigint, known_id bigint, foreign_id bigint, fuzzy bigint, review bigint, failed bigint"

#: Open releases to their outcomes: ``id``, ``series_id``, ``path``, ``confidence``, ``status``.
Resolver = Callable[[DataFrame], DataFrame]


def discovered(items: DataFrame, source_name: str, now: int) -> DataFrame:
    """Releases of feed items as new rows of the release table, one a key."""
    found = feeds.releases_of(items, source_name)
    found = merges.latest(found, KEY, F.col("posted_at"))
    empty = {"files": "array<string>", "series_id": "bigint", "resolution_path": "string", "resolution_confidence": "double", "resolved_at": "bigint"}
    rows = found.withColumns({c: F.lit(None).cast(kind) for c, kind in empty.items()})
    return rows.withColumns({"id": F.concat_ws(":", *KEY), "resolution_status": F.lit("unresolved"), "resolution_attempts": F.lit(0), "observed_at": F.lit(now).cast("bigint")})


def poll_tick(tables: TableSet, batch: DataFrame, number: int, source_name: str, now: int, resolve: Resolver | None = None) -> bool:
    """One tick of a source: bodies in, releases, links to the source, its state and a run row out, as one commit.

    ``batch`` has ``body``.  A body that the source's last one equals byte for
    byte is not modified and not parsed.  Releases are merged without
    degrading stored details; those of this tick that no operator decided are
    resolved and linked.  A tick that was committed is skipped; one that fails
    anywhere leaves nothing and can be tried again under its number.
    """
    spark, stream = batch.sparkSession, f"poll:{source_name}"
    if tables.done(stream, number):
        return False
    state = tables.read("source_state")
    last = None if state is None else state.where(F.col("source_name") == source_name).select("etag").first()
    bodies = settled(batch.select("body", F.md5("body").alias("etag")))
    fresh = bodies.where(~F.col("etag").eqNullSafe(F.lit(last and last[0])))
    items = settled(feeds.items_of(fresh.select("body")))
    found = settled(discovered(items, source_name, now))
    stored = tables.lookup("releases", found)
    stored = found.limit(0) if stored is None else stored
    before = stored.count()
    merged = settled(merges.upsert_releases(stored, found, SIGHTED, DETAILED))
    if resolve is not None:
        undecided = merged.where(~F.col("resolution_status").isin("rejected", "standalone", "resolved") & ~F.col("resolution_path").eqNullSafe("manual"))
        outcomes = settled(resolve(undecided))
        merged = settled(merges.link(merged, outcomes, now))
        tally = aggregates.outcome_tally(outcomes.select(F.col("path").alias("resolution_path"), F.col("status").alias("resolution_status"))).first().asDict()
    else:
        tally = dict.fromkeys(("known_id", "foreign_id", "fuzzy", "review", "failed"), 0)
    releases, parsed = merged.count(), items.count()
    counts = {"fetched": parsed, "unmodified": bodies.count() - fresh.count(), "broken": parsed - feeds.releases_of(items, source_name).count(), "new": releases - before, **tally}
    run = {"run": f"{source_name}/{number}", "source_name": source_name, "started_at": now, "finished_at": now, "status": "success", **counts}
    tag = fresh.agg(F.max("etag")).first()[0] or (last and last[0])
    columns = [c.split()[0] for c in RUN.split(", ")]
    links = merged.select(F.col("id").alias("release_id"), F.lit(source_name).alias("source_name"))
    return tables.commit(
        stream,
        number,
        {
            "releases": Change(KEY, merged, replaced(KEY)),
            "release_sources": Change(["release_id", "source_name"], links, kept_first(["release_id", "source_name"])),
            "source_state": Change(["source_name"], spark.createDataFrame([(source_name, tag, now, f"{parsed} fetched, {counts['new']} new")], "source_name string, etag string, last_poll_at bigint, summary string"), replaced(["source_name"])),
            "runs": Change(["run"], spark.createDataFrame([tuple(run[c] for c in columns)], RUN), replaced(["run"])),
        },
    )


def poll_feeds(spark: SparkSession, incoming: str, tables: TableSet, checkpoint: str, source_name: str, clock: Callable[[], int], resolve: Resolver | None = None) -> StreamingQuery:
    """Feed files as they arrive, a tick for each micro-batch; a replayed one changes nothing."""
    files = spark.readStream.schema("value string").option("wholetext", True).text(incoming)

    def tick(batch: DataFrame, number: int) -> None:
        poll_tick(tables, batch.withColumnRenamed("value", "body"), number, source_name, clock(), resolve)

    return files.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_sightings(events: DataFrame, keys: list[str], stamp: str, delay: str = "72 hours") -> DataFrame:
    """Each key once; keys older than the watermark are forgotten, so state stays bounded."""
    return events.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(keys)


def late_details(releases: DataFrame, tried: DataFrame, now: int) -> DataFrame:
    """The newest recent releases without files that this tick has not tried yet."""
    recent = releases.where(F.col("files").isNull() & between_times("observed_at", now - LATE_WINDOW, now + 1))
    return paging.newest(recent.join(tried.select("id"), "id", "left_anti"), "observed_at", LATE_ROWS)


def newest_of(key: str, stamp: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Of stored and incoming rows of a key the one with the greatest stamp; of equal stamps the stored one."""

    def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        both = stored.withColumn("_old", F.lit(True)).unionByName(incoming.withColumn("_old", F.lit(False)))
        return merges.latest(both, [key], F.col(stamp), F.col("_old")).drop("_old")

    return merge


def follow_changes(spark: SparkSession, changes: str, schema: str, tables: TableSet, name: str, checkpoint: str) -> StreamingQuery:
    """Change feed into a table of the set, by ``id``: at least once, the last ``updated_at`` wins; only touched buckets are written."""
    rows = spark.readStream.schema(schema).parquet(changes)

    def merge(batch: DataFrame, number: int) -> None:
        new = settled(merges.latest(batch.where("updated_at > 0"), ["id"], F.col("updated_at")))
        tables.commit(f"changes:{name}", number, {name: Change(["id"], new, newest_of("id", "updated_at"))})

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(runs: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Runs by source and status in tumbling event-time windows."""
    return runs.withWatermark("ts", delay).groupBy(F.window("ts", width), "source", "status").agg(F.count("*").alias("n"))
