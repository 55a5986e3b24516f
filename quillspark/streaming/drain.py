"""Refreshing every stale row in bounded batches, to a fixed point."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.lineage import settled
from quillspark.sources.tables import Change, TableSet, replaced

#: Rows of a batch where none is given.
FALLBACK = 50

#: Stale rows to what the provider says: ``id``, ``result`` (``updated``, ``unchanged``, ``missing``, ``failed``, ``provider_error``), ``metadata_hash``.
Fetch = Callable[[DataFrame], DataFrame]


@dataclass
class Drained:
    """What a drain did: rows by result, batches, and why it ended (``done``, ``aborted``, ``ceiling``)."""

    counts: dict[str, int]
    batches: int
    ended: str
    ceiling: int


def ceiling(total: int, size: int) -> int:
    """Batches after which a drain gives up: enough for all rows, and two."""
    return total // size + 2


def stale(series: DataFrame, cutoff: int, size: int) -> DataFrame:
    """The ``size`` rows fetched longest ago among those fetched before ``cutoff``; never fetched ones first, then by id."""
    old = series.where(F.col("fetched_at").isNull() | (F.col("fetched_at") < cutoff))
    return old.orderBy(F.col("fetched_at").asc_nulls_first(), "id").limit(size)


def drain(tables: TableSet, fetch: Fetch, cutoff: int, size: int = 0, name: str = "series") -> Drained:
    """Fetch all rows of ``name`` (by ``id``) that are older than ``cutoff`` anew.

    The cutoff is taken once, at the start, and a fetched row is stamped with
    it, so each row is met once; missing and failed rows are stamped, too, and
    keep their hash.  A provider's error stamps the rows of its batch before
    the first such row by id, and ends the drain.  A row that does not advance
    can't hold it up for ever: it ends at the ceiling.  Each batch is one
    commit, numbered within the cutoff; started again with the same cutoff it
    goes on where it ended.
    """
    size = size if size > 0 else FALLBACK
    stream = f"drain:{name}:{cutoff}"
    total = stale(tables.read(name), cutoff, 2**31 - 1).count()
    most, counts, batches, ended = ceiling(total, size), {}, 0, "done"
    number = tables.state()["batches"].get(stream, -1)
    while True:
        if batches >= most:
            ended = "ceiling" if stale(tables.read(name), cutoff, 1).count() else "done"
            break
        batch = settled(stale(tables.read(name), cutoff, size))
        if not batch.count():
            break
        batches, number = batches + 1, number + 1
        answers = settled(fetch(batch).select("id", "result", F.col("metadata_hash").alias("_hash")))
        stop = answers.where("result = 'provider_error'").agg(F.min("id")).first()[0]
        held = answers if stop is None else answers.where(F.col("id") < stop)
        for r in held.groupBy("result").count().collect():
            counts[r["result"]] = counts.get(r["result"], 0) + r["count"]
        new = F.when(F.col("result") == "updated", F.col("_hash")).otherwise(F.col("metadata_hash"))
        done = batch.join(held, "id").withColumns({"metadata_hash": new, "fetched_at": F.lit(cutoff).cast("bigint")}).select(*batch.columns)
        tables.commit(stream, number, {name: Change(["id"], settled(done), replaced(["id"]))})
        if stop is not None:
            counts["provider_error"] = 1
            ended = "aborted"
            break
    return Drained(counts, batches, ended, most)
