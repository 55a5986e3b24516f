"""Keyed tables by bucket, commits over several tables, poll ticks, drains."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.sources import snapshot
from quillspark.sources.tables import Change, TableSet, kept_first, replaced
from quillspark.streaming import drain as dr
from quillspark.streaming import jobs
from tests.test_sources import item, rss


@pytest.fixture
def tables(spark, tmp_path):
    return TableSet(spark, f"file://{tmp_path}/tables")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_small_change_writes_few_buckets(spark, tables, tmp_path):
    first = spark.range(20_000).withColumn("v", F.lit("old"))
    assert tables.read("t") is None and tables.lookup("t", first) is None
    assert tables.commit("s", 0, {"t": Change(["id"], first, replaced(["id"]))})
    before = tables.state()["tables"]["t"]["folders"]
    assert len(before) == 256
    few = spark.range(0, 20_000, 2_000).withColumn("v", F.lit("new"))
    assert tables.commit("s", 1, {"t": Change(["id"], few, replaced(["id"]))})
    after = tables.state()["tables"]["t"]["folders"]
    changed = {n for n in after if after[n] != before[n]}
    assert 1 <= len(changed) <= 10
    new = {f.rsplit("/", 1)[0] for n, f in after.items() if n in changed}
    assert len(new) == 1 and len(list((tmp_path / "tables" / new.pop()).glob("_bucket=*"))) == len(changed)
    assert tables.read("t").where("v = 'new'").count() == 10 and tables.read("t").count() == 20_000
    assert rows(tables.lookup("t", few.limit(3)).select("v")) == [("new",)] * 3
    # a replayed change does nothing
    state = tables.state()
    assert not tables.commit("s", 1, {"t": Change(["id"], few.withColumn("v", F.lit("again")), replaced(["id"]))})
    assert tables.state() == state
    with pytest.raises(ValueError):
        tables.commit("s", 2, {"t": Change(["v"], few, replaced(["v"]))})


def test_buckets_that_become_empty_and_old_readers(spark, tables):
    data = spark.range(50).withColumn("v", F.lit(1))
    tables.commit("s", 0, {"t": Change(["id"], data, replaced(["id"]))})
    opened = tables.read("t")
    tables.commit("s", 1, {"t": Change(["id"], data.limit(0), replaced(["id"]))})
    gone = lambda stored, incoming: stored.join(incoming.select("id"), "id", "left_anti")
    tables.commit("s", 2, {"t": Change(["id"], data.where("id < 45"), gone)})
    assert sorted(r["id"] for r in tables.read("t").collect()) == [45, 46, 47, 48, 49]
    assert opened.count() == 50  # its state is still kept
    tables.commit("s", 3, {"t": Change(["id"], data, gone)})
    assert tables.read("t").collect() == [] and tables.read("t").columns == ["id", "v"]


def test_a_crash_leaves_the_former_state(spark, tables, monkeypatch):
    a, b = spark.range(5).withColumn("v", F.lit("a")), spark.range(3, 8).withColumn("v", F.lit("b"))
    both = lambda df: {"t": Change(["id"], df, replaced(["id"])), "u": Change(["id"], df, kept_first(["id"]))}
    tables.commit("s", 0, both(a))
    # between the two tables
    broken = both(b)
    broken["u"].merge = lambda stored, incoming: 1 / 0
    with pytest.raises(ZeroDivisionError):
        tables.commit("s", 1, broken)
    assert rows(tables.read("t")) == rows(a) and rows(tables.read("u")) == rows(a)
    # right before the rename
    with monkeypatch.context() as m:
        m.setattr(snapshot, "_rename_pointer", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            tables.commit("s", 1, both(b))
    assert rows(tables.read("t")) == rows(a) and not tables.done("s", 1)
    assert tables.commit("s", 1, both(b)) and tables.done("s", 1)
    assert rows(tables.read("t")) == [(i, "a") for i in range(3)] + [(i, "b") for i in range(3, 8)]
    assert rows(tables.read("u")) == [(i, "a") for i in range(5)] + [(i, "b") for i in range(5, 8)]
    assert tables.clean() == 3 and tables.clean() == 0
    assert tables.read("t").count() == tables.read("u").count() == 8


def tick(spark, tables, number, bodies, resolve=None):
    return jobs.poll_tick(tables, spark.createDataFrame([(b,) for b in bodies], "body string"), number, "src", 1000 + number, resolve)


def by_title(releases):
    return releases.select("id", F.lit(7).cast("bigint").alias("series_id"), F.lit("fuzzy_title").alias("path"), F.lit(0.9).alias("confidence"), F.lit("resolved").alias("status")).where(F.col("id") != "feed:3")


def test_a_tick_commits_releases_links_state_and_run(spark, tables):
    first, second = rss(item(1), item(2), "<item><title>x</title></item>"), rss(item(2, title="Renamed"), item(3))
    assert tick(spark, tables, 0, [first], by_title)
    assert {(r["external_id"], r["resolution_status"], r["series_id"], r["resolved_at"]) for r in tables.read("releases").collect()} == {("1", "resolved", 7, 1000), ("2", "resolved", 7, 1000)}
    run = tables.read("runs").first()
    assert (run["run"], run["status"], run["fetched"], run["broken"], run["new"], run["fuzzy"]) == ("src/0", "success", 3, 1, 2, 2)
    assert tick(spark, tables, 1, [second], by_title)
    got = {r["external_id"]: (r["title"], r["observed_at"], r["resolution_status"], r["resolution_attempts"]) for r in tables.read("releases").collect()}
    assert got == {"1": ("Name v01", 1000, "resolved", 1), "2": ("Renamed", 1000, "resolved", 1), "3": ("Name v03", 1001, "unresolved", 0)}
    assert not tick(spark, tables, 1, [second], by_title)
    # the same body as the last one is not parsed
    assert tick(spark, tables, 2, [second], by_title)
    runs = {r["run"]: (r["fetched"], r["unmodified"], r["new"]) for r in tables.read("runs").collect()}
    assert runs == {"src/0": (3, 0, 2), "src/1": (2, 0, 1), "src/2": (0, 1, 0)}
    assert rows(tables.read("release_sources")) == [(f"feed:{n}", "src") for n in (1, 2, 3)]
    state = tables.read("source_state").first()
    assert state["last_poll_at"] == 1002 and state["summary"] == "0 fetched, 0 new" and len(state["etag"]) == 32
    assert tick(spark, tables, 3, ["no feed at all", ""], by_title)
    assert tables.read("releases").count() == 3


def test_a_tick_that_fails_is_tried_again_whole(spark, tables):
    def dies(releases):
        raise OSError("provider")

    with pytest.raises(OSError):
        tick(spark, tables, 0, [rss(item(1))], dies)
    assert tables.read("releases") is None and tables.state()["version"] == 0
    assert tick(spark, tables, 0, [rss(item(1))], by_title)
    assert tables.read("releases").count() == tables.read("runs").count() == 1


def test_polled_feeds_are_merged_once(spark, tables, tmp_path):
    incoming, state = (f"file://{tmp_path}/{x}" for x in ("in", "state"))
    (tmp_path / "in").mkdir()
    poll = lambda: jobs.poll_feeds(spark, incoming, tables, state, "src", lambda: 5, by_title).awaitTermination()
    (tmp_path / "in/1.xml").write_text(rss(item(1), item(2)))
    poll()
    assert {r["title"] for r in tables.read("releases").collect()} == {"Name v01", "Name v02"}
    (tmp_path / "in/2.xml").write_text(rss(item(2, title="Renamed"), item(3)))
    for _ in range(2):  # the second run finds nothing new
        poll()
    assert {r["external_id"]: r["title"] for r in tables.read("releases").collect()} == {"1": "Name v01", "2": "Renamed", "3": "Name v03"}
    assert tables.read("runs").count() == 2


SERIES = "id bigint, metadata_hash string, fetched_at bigint"


def start(spark, tables, n):
    tables.commit("load", 0, {"series": Change(["id"], spark.createDataFrame([(i, "old", None if i % 5 == 0 else i) for i in range(n)], SERIES), replaced(["id"]))})


def answer(**special):
    def fetch(batch):
        result = F.lit("updated")
        for name, ids in special.items():
            result = F.when(F.col("id").isin(ids), F.lit(name)).otherwise(result)
        return batch.select("id", result.alias("result"), F.lit("new").alias("metadata_hash"))

    return fetch


def test_drain_meets_each_stale_row_once(spark, tables):
    start(spark, tables, 23)
    done = dr.drain(tables, answer(missing=[3], failed=[4], unchanged=[5]), 20, 5)
    # 20, 21 and 22 have been fetched at 20 or later, but 20 was never fetched at all
    assert (done.counts, done.batches, done.ended, done.ceiling) == ({"updated": 18, "missing": 1, "failed": 1, "unchanged": 1}, 5, "done", 6)
    got = {r["id"]: (r["metadata_hash"], r["fetched_at"]) for r in tables.read("series").collect()}
    assert got[3] == got[4] == got[5] == ("old", 20) and got[0] == got[20] == ("new", 20) and got[21] == ("old", 21)
    assert dr.drain(tables, answer(), 20, 5).batches == 0


def test_drain_stops_at_a_provider_error_and_goes_on(spark, tables):
    start(spark, tables, 12)
    first = dr.drain(tables, answer(provider_error=[7]), 100, 4)
    assert first.ended == "aborted" and first.counts["provider_error"] == 1
    fresh = tables.read("series").where("fetched_at = 100").count()
    assert 0 < fresh < 12
    second = dr.drain(tables, answer(), 100, 4)
    assert second.ended == "done" and second.counts["updated"] == 12 - fresh
    assert {r["metadata_hash"] for r in tables.read("series").collect()} == {"new"}


def test_drain_gives_up_on_rows_that_do_not_advance(spark, tables):
    start(spark, tables, 6)
    stuck = dr.drain(tables, lambda batch: answer()(batch).where("id <> 0"), 100, 2)
    assert stuck.ended == "ceiling" and stuck.batches == dr.ceiling(6, 2) == 5
    assert dr.drain(tables, answer(), 50, 0).ended == "done"
