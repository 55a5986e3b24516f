"""Resolving releases anew: which ones, by which driver, and what became of them; links that operators ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import entities, merges
from quillspark.operators.aggregates import retry_tally
from quillspark.operators.lineage import settled
from quillspark.operators.paging import top_per_group
from quillspark.operators.resolution import open_releases

#: Rows of each status that a driver takes.
LIMIT = 1000
#: Statuses of the drivers: what found nothing, the review queue, and all but decisions of an operator.
DRIVERS = {
    "unresolved": ["unresolved", "ambiguous"],
    "queue": ["unresolved", "ambiguous", "review_pending"],
    "all": ["unresolved", "ambiguous", "review_pending", "resolved"],
}

#: Releases to their outcomes: ``id``, ``series_id``, ``path``, ``confidence``, ``status``; a row may be missing where resolving it failed.
Resolver = Callable[[DataFrame], DataFrame]


def selected(releases: DataFrame, driver: str, limit: int = LIMIT) -> DataFrame:
    """The newest ``limit`` releases of each status of a driver; resolved ones only if no operator linked them."""
    rows = releases.where(F.col("resolution_status").isin(DRIVERS[driver]))
    by_hand = (F.col("resolution_status") == "resolved") & F.col("resolution_path").eqNullSafe("manual")
    return top_per_group(rows.where(~by_hand), ["resolution_status"], limit, F.col("observed_at").desc(), F.col("id")).drop("rank")


def retried(releases: DataFrame, chosen: DataFrame, resolve: Resolver, now: int, forced: bool = False) -> tuple[DataFrame, DataFrame]:
    """``releases`` after those of ``chosen`` (``id``) were resolved anew, and the tally of outcomes (one row).

    What an operator decided is skipped unless ``forced``.  Ids that are no
    release, and releases without an outcome, count as errors and change nothing.
    """
    wanted = chosen.select("id").distinct()
    there = settled(releases.join(wanted, "id", "left_semi"))
    asked = open_releases(there, forced=forced)
    outcomes = settled(resolve(asked))
    marked = wanted.join(there.select("id", F.lit(True).alias("_there")), "id", "left").join(asked.select("id", F.lit(True).alias("_asked")), "id", "left")
    marked = marked.join(outcomes.select("id", F.col("status").alias("resolution_status")), "id", "left")
    skipped = F.col("_there").isNotNull() & F.col("_asked").isNull()
    failed = F.col("_there").isNull() | (F.col("_asked").isNotNull() & F.col("resolution_status").isNull())
    tally = retry_tally(marked.select("resolution_status", skipped.alias("skipped"), failed.alias("failed")))
    return merges.link(releases, outcomes, now), tally


def linked_by_hand(requests: DataFrame, releases: DataFrame, series: DataFrame, mapping: DataFrame, records: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Carry out link requests (``request``: a release's id; see ``merges.link_targets``), all at once.

    Targets that have no series yet get one made of their record (``records``:
    ``provider``, ``external_id``, ``foreign_ids`` and columns of series; the
    first request's place is theirs), or share the series that one of their
    ids leads to.  Returns the requests with ``series_id`` or ``error``, and
    releases, series and mapping after them.
    """
    targets = settled(merges.link_targets(requests, series, mapping, records))
    wanted = requests.join(targets.where("make").select("request"), "request").groupBy("provider", "external_id").agg(F.min("request").alias("place"))
    new = settled(records.join(wanted, ["provider", "external_id"]))
    series, mapping, assigned = entities.persist(series, mapping, new, now)
    series, mapping, assigned = settled(series), settled(mapping), settled(assigned)
    made = wanted.join(assigned, "place").select("provider", "external_id", F.col("series_id").alias("_made"))
    done = targets.join(requests.select("request", "provider", "external_id"), "request").join(made, ["provider", "external_id"], "left")
    done = settled(done.select("request", F.when(F.col("error").isNull(), F.coalesce("series_id", "_made")).alias("series_id"), "error"))
    links = done.where("series_id is not null").select(F.col("request").alias("id"), "series_id", F.lit("manual").alias("path"), F.lit(1.0).alias("confidence"), F.lit("resolved").alias("status"))
    return done, merges.link(releases, links, now), series, mapping
