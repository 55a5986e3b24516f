"""Table merges.  Each returns the new state of a table as a DataFrame.

Parquet has no row updates: the caller writes the result to a new place and
swaps (see ``sources.snapshot``); with a table format the same frames feed its
merge command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Release columns: written by every sighting, and detail columns kept if a sighting has no details.
MUTABLE = ["title", "link", "magnet", "torrent_url", "ddl_url", "info_hash", "size_bytes", "posted_at"]
DETAILS = ["files", "description_html", "extracted_links", "comment_suggested_links", "information_url", "volume_span", "chapter_span"]


def _sides(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with prefixed columns ``s_``/``i_`` and flags ``has_s``/``has_i``."""
    s = stored.select(*keys, F.lit(True).alias("has_s"), *[F.col(c).alias(f"s_{c}") for c in stored.columns if c not in keys])
    i = incoming.select(*keys, F.lit(True).alias("has_i"), *[F.col(c).alias(f"i_{c}") for c in incoming.columns if c not in keys])
    return s.join(i, keys, "full_outer")


def latest(incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the last one in the given order."""
    rest = [c for c in incoming.columns if c not in keys]
    best = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, "b.*").select(*incoming.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], overwrite: list[str]) -> DataFrame:
    """Incoming rows replace the ``overwrite`` columns of stored ones, or are inserted whole.

    One incoming row a key is expected.
    """
    both = _sides(stored, incoming, keys)
    columns = []
    for c in stored.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in overwrite:
            columns.append(F.when(F.col("has_i"), F.col(f"i_{c}")).otherwise(F.col(f"s_{c}")).alias(c))
        else:
            columns.append(F.when(F.col("has_s"), F.col(f"s_{c}")).otherwise(F.col(f"i_{c}")).alias(c))
    return both.select(*columns)


def upsert_releases(stored: DataFrame, incoming: DataFrame, mutable: list[str] | None = None, details: list[str] | None = None, marker: str = "files") -> DataFrame:
    """Release upsert on (source_kind, external_id) that never degrades.

    Mutable columns follow the sighting; detail columns do, unless it has no
    ``marker`` while the stored row has; all others stay as first stored.
    """
    mutable = MUTABLE if mutable is None else mutable
    details = DETAILS if details is None else details
    keys = ["source_kind", "external_id"]
    both = _sides(stored, incoming, keys)
    poorer = F.col(f"i_{marker}").isNull() & F.col(f"s_{marker}").isNotNull()
    columns = []
    for c in stored.columns:
        if c in keys:
            columns.append(F.col(c))
            continue
        old, new = F.col(f"s_{c}"), F.col(f"i_{c}")
        if c in mutable:
            value = F.when(F.col("has_i"), new).otherwise(old)
        elif c in details:
            value = F.when(F.col("has_i") & ~F.coalesce(F.col("has_s") & poorer, F.lit(False)), new).otherwise(old)
        else:
            value = F.when(F.col("has_s"), old).otherwise(new)
        columns.append(value.alias(c))
    return both.select(*columns)


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those incoming whose key is new, one a key."""
    fresh = incoming.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return stored.unionByName(fresh.select(*stored.columns))


def insert_external_ids(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Mappings (provider, external_id, series_id): an id keeps its series, a series its first id of a provider."""
    held = stored.hint("merge")  # a union of settled tables is estimated by their files, so it might be broadcast
    fresh = incoming.join(held.select("provider", "external_id"), ["provider", "external_id"], "left_anti").join(held.select("provider", "series_id"), ["provider", "series_id"], "left_anti")
    by_id = fresh.groupBy("provider", "external_id").agg(F.min_by("series_id", "place").alias("series_id"), F.min("place").alias("place"))
    by_series = by_id.groupBy("provider", "series_id").agg(F.min_by("external_id", "place").alias("external_id"))
    return stored.select("provider", "external_id", "series_id").unionByName(by_series.select("provider", "external_id", "series_id"))


def replace_for_keys(stored: DataFrame, incoming: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """All rows of the touched keys are replaced by the incoming ones; other keys stay."""
    return stored.join(touched.select(key), key, "left_anti").unionByName(incoming.select(*stored.columns))


def appended(history: DataFrame, snapshot: DataFrame, stamp: str) -> DataFrame:
    """A history with one more snapshot; one of the same time is there already and stays."""
    return history.unionByName(snapshot.join(history.select(stamp), stamp, "left_anti").select(*history.columns))


def run_history(opened: DataFrame, closed: DataFrame, id: str = "id") -> DataFrame:
    """Runs from open and close events: a run without a close event is ``running``."""
    ends = latest(closed, [id], F.col("finished_at"))
    return opened.join(ends, id, "left").withColumn("status", F.coalesce("status", F.lit("running")))


def progress(stored: DataFrame, update: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """Progress fields with values where the update has them, else as they were."""
    new = update.select(id, *[F.col(c).alias(f"_{c}") for c in columns])
    rows = stored.join(new, id, "left")
    return rows.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def interrupt_running(runs: DataFrame, now: int) -> DataFrame:
    """After a crash: runs still open end as errors."""
    open_ = F.col("outcome") == "running"
    return runs.withColumn("finished_at", F.when(open_, F.lit(now).cast("bigint")).otherwise(F.col("finished_at"))).withColumn("error", F.when(open_, F.lit("interrupted")).otherwise(F.col("error"))).withColumn("outcome", F.when(open_, F.lit("error")).otherwise(F.col("outcome")))


def reject(releases: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Rejects releases by id: no series, no confidence, one attempt more, resolved now."""
    rows = releases.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    hit = F.col("hit").isNotNull()
    return rows.select(
        *[F.col(c) for c in releases.columns if c not in ("series_id", "resolution_path", "resolution_confidence", "resolution_status", "resolution_attempts", "last_resolve_attempt_at")],
        F.when(~hit, F.col("series_id")).alias("series_id"),
        F.when(hit, F.lit("rejected")).otherwise(F.col("resolution_path")).alias("resolution_path"),
        F.when(~hit, F.col("resolution_confidence")).alias("resolution_confidence"),
        F.when(hit, F.lit("rejected")).otherwise(F.col("resolution_status")).alias("resolution_status"),
        (F.col("resolution_attempts") + hit.cast("int")).alias("resolution_attempts"),
        F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("last_resolve_attempt_at")).alias("last_resolve_attempt_at"),
    )


def link(releases: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """Writes resolution outcomes (``id``, ``series_id``, ``path``, ``confidence``, ``status``), one an id.

    Attempts grow by one; the time of the first resolution is set once and stays.
    """
    new = outcomes.select("id", F.lit(True).alias("hit"), F.col("series_id").alias("n_series"), F.col("path").alias("n_path"), F.col("confidence").alias("n_confidence"), F.col("status").alias("n_status"))
    rows = releases.join(new, "id", "left")
    hit = F.col("hit").isNotNull()
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old)
    first = F.when(hit & F.col("n_series").isNotNull(), F.coalesce("resolved_at", F.lit(now).cast("bigint"))).otherwise(F.col("resolved_at"))
    changed = {
        "series_id": pick("n_series", "series_id"),
        "resolution_path": pick("n_path", "resolution_path"),
        "resolution_confidence": pick("n_confidence", "resolution_confidence"),
        "resolution_status": pick("n_status", "resolution_status"),
        "resolution_attempts": (F.col("resolution_attempts") + hit.cast("int")).alias("resolution_attempts"),
        "resolved_at": first.alias("resolved_at"),
    }
    return rows.select(*[changed.get(c, F.col(c)) for c in releases.columns])


def affected_series(before: DataFrame, after: DataFrame) -> DataFrame:
    """Series whose releases changed between two states: old and new owners."""
    old = before.select("id", F.col("series_id").alias("old"))
    moved = after.select("id", F.col("series_id").alias("new")).join(old, "id").where(~F.col("old").eqNullSafe(F.col("new")))
    return moved.select(F.explode(F.array_compact(F.array("old", "new"))).alias("series_id")).distinct()


def edit(rows: DataFrame, ids: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns of the rows with these ids that meet the condition; ``edited`` tells which."""
    marked = rows.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce(F.col("_hit") & condition, F.lit(False))
    out = marked.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns], hit.alias("edited"))
    return out


def invalidate_hashes(series: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Hashes of rows not made by hand become null, optionally only of mapped series.

    ``invalidated`` and ``skipped`` tell which rows lost theirs and which kept
    them as made by hand.
    """
    scope = F.lit(True)
    rows = series
    if mapped is not None:
        rows = series.join(mapped.select(F.col("series_id").alias("id"), F.lit(True).alias("_in")).distinct(), "id", "left")
        scope = F.col("_in").isNotNull()
    manual = F.col("metadata_source") == "manual"
    hit = scope & ~manual & F.col("metadata_hash").isNotNull()
    out = rows.withColumn("invalidated", hit).withColumn("skipped", scope & manual)
    return out.withColumn("metadata_hash", F.when(~hit, F.col("metadata_hash"))).select(*series.columns, "invalidated", "skipped")


def purge(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of the ids that go."""
    return {name: df.join(gone.select(F.col("id").alias(keys[name])), keys[name], "left_anti") for name, df in tables.items()}


def merge_library_links(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Sweep result into library links: manual ones stay, automatic ones follow the sweep or go."""
    manual = stored.where(F.col("link_kind") == "manual")
    auto = found.join(manual.select("series_id"), "series_id", "left_anti").withColumn("link_kind", F.lit("auto"))
    return manual.unionByName(auto.select(*stored.columns))


def locate_series(records: DataFrame, mapping: DataFrame, provider: str) -> DataFrame:
    """Where provider records belong: by their own id, else by the first foreign id whose series
    has no other id of this provider; ``series_id`` is null for new ones.

    ``records``: ``external_id``, ``foreign_ids`` (array of provider, id).
    """
    own = mapping.where(F.col("provider") == provider).select("external_id", F.col("series_id").alias("own"))
    taken = mapping.where(F.col("provider") == provider).select("series_id", F.col("external_id").alias("held"))
    pairs = records.select(F.col("external_id").alias("record"), F.posexplode("foreign_ids").alias("pos", "f"))
    hits = pairs.join(mapping, (F.col("f.provider") == F.col("provider")) & (F.col("f.id") == F.col("external_id"))).select("record", "pos", "series_id")
    free = hits.join(taken, "series_id", "left").where(F.col("held").isNull() | (F.col("held") == F.col("record")))
    first = free.groupBy("record").agg(F.min_by("series_id", F.struct("pos", "series_id")).alias("foreign"))
    return records.join(own, "external_id", "left").join(first.withColumnRenamed("record", "external_id"), "external_id", "left").withColumn("series_id", F.coalesce("own", "foreign")).drop("own", "foreign")


def upsert_from_metadata(series: DataFrame, located: DataFrame, overwrite: list[str], now: int, allow_manual: bool = False) -> DataFrame:
    """Series with located provider records: equal hashes change nothing, hand-made rows are locked."""
    new = located.where(F.col("series_id").isNotNull()).select(F.col("series_id").alias("id"), *[F.col(c).alias(f"n_{c}") for c in [*overwrite, "metadata_hash"]])
    rows = series.join(new, "id", "left")
    unlocked = F.lit(True) if allow_manual else F.col("metadata_source") != "manual"
    hit = F.coalesce(F.col("n_metadata_hash").isNotNull() & unlocked & ~F.col("n_metadata_hash").eqNullSafe(F.col("metadata_hash")), F.lit(False))
    columns = []
    for c in series.columns:
        if c in overwrite or c == "metadata_hash":
            columns.append(F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            columns.append(F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return rows.select(*columns)


def insert_from_metadata(series: DataFrame, located: DataFrame, now: int) -> DataFrame:
    """``series`` with a new row for each located record that has no series yet.

    New ids follow the greatest one, by the first two digits of the SHA-256 of
    the provider's id, then that id; the records' columns are taken by name,
    others are null; rows come from the provider and are stamped ``now``.
    Numbers come from counts of the 256 ranges, so no task numbers all records.
    """
    new = located.where(F.col("series_id").isNull()).dropDuplicates(["external_id"])
    part = F.substring(F.sha2(F.col("external_id"), 256), 1, 2)
    new = new.withColumn("_part", part)
    sizes = new.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    last = series.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_last"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("external_id"))
    numbered = new.withColumn("_own", own).join(F.broadcast(before), "_part").crossJoin(F.broadcast(last))
    fixed = {"id": F.col("_last") + F.col("_before") + F.col("_own"), "metadata_source": F.lit("provider"), "updated_at": F.lit(now), "created_at": F.lit(now), "fetched_at": F.lit(now)}
    columns = [(fixed[c] if c in fixed else F.col(c) if c in new.columns else F.lit(None)).cast(series.schema[c].dataType).alias(c) for c in series.columns]
    return series.unionByName(numbered.select(*columns))


def link_targets(requests: DataFrame, series: DataFrame, mapping: DataFrame, records: DataFrame) -> DataFrame:
    """Where an operator's link requests lead: ``request``, ``series_id``, ``make`` (a record to insert), ``error``.

    ``requests``: ``request`` and either ``series_id`` or both of ``provider``
    and ``external_id``.  A pair leads to the series that holds it, else to a
    provider record (``records``: ``provider``, ``external_id``) from which a
    series is to be made; everything else is an error.
    """
    by_id, pair = F.col("series_id").isNotNull(), F.col("provider").isNotNull() & F.col("external_id").isNotNull()
    half = F.col("provider").isNotNull() | F.col("external_id").isNotNull()
    sound = (by_id & ~half) | (~by_id & pair)
    known = series.select(F.col("id").alias("series_id"), F.lit(True).alias("_there")).distinct()
    held = mapping.select("provider", "external_id", F.col("series_id").alias("_held"))
    listed = records.select("provider", "external_id", F.lit(True).alias("_listed")).distinct()
    rows = requests.join(known, "series_id", "left").join(held, ["provider", "external_id"], "left").join(listed, ["provider", "external_id"], "left")
    error = (
        F.when(~sound, F.lit("bad_request"))
        .when(by_id & F.col("_there").isNull(), F.lit("not_found"))
        .when(~by_id & F.col("_held").isNull() & F.col("_listed").isNull(), F.lit("no_record"))
    )
    target = F.when(error.isNull(), F.coalesce("series_id", "_held"))
    return rows.select("request", target.alias("series_id"), (error.isNull() & target.isNull()).alias("make"), error.alias("error"))
