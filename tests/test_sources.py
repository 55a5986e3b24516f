"""Feeds, pages, indexes, snapshots and streaming jobs on small files."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import feeds, pages, snapshot
from quillspark.sources.tables import TableSet
from quillspark.streaming import jobs

BASE = "https://feed.example"


def item(n, title=None, date="Mon, 01 Jan 2024 10:00:00 -0000", **more):
    fields = {"title": f"<![CDATA[{title or f'Name v{n:02d}'}]]>", "link": f"{BASE}/download/{n}.torrent", "guid": f"{BASE}/view/{n}", "pubDate": date, "x:size": "1.5 GiB", "x:infoHash": f"ABC{n}", "description": '&lt;a href="https://anilist.co/manga/7"&gt;x&lt;/a&gt;'} | more
    return "<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in fields.items() if v is not None) + "</item>"


def rss(*items):
    return f'<?xml version="1.0"?><rss xmlns:x="https://x"><channel><title>f</title>{"".join(items)}</channel></rss>'


def test_feed_items_by_either_reader(spark, tmp_path):
    body = rss(item(1), item(2, title="A &amp; B"), item(3, date="nonsense"), item(4, guid=None), item(5, title="  "))
    (tmp_path / "feed.xml").write_text(body)
    by_column = feeds.releases_of(feeds.items_of(spark.createDataFrame([(body,), ("no feed",)], "body string")), "src")
    by_reader = feeds.releases_of(feeds.read_items(spark, str(tmp_path / "feed.xml")), "src")
    for found in (by_column, by_reader):
        rows = {r["external_id"]: r for r in found.collect()}
        assert set(rows) == {"1", "2"}
        one = rows["1"]
        assert (one["title"], one["link"], one["torrent_url"], one["info_hash"], one["size_bytes"]) == ("Name v01", f"{BASE}/view/1", f"{BASE}/download/1.torrent", "abc1", 1610612736)
        assert one["posted_at"] == datetime.datetime(2024, 1, 1, 10) and one["external_links"]["anilist"] == "https://anilist.co/manga/7"
        assert one["magnet"] == "magnet:?xt=urn:btih:abc1&dn=Name%20v01"


def test_addresses():
    assert feeds.page_address(f"{BASE}/?page=rss&c=3_1&p=9", 2) == f"{BASE}/?c=3_1&p=2"
    assert feeds.page_address(f"{BASE}/?page=rss&q=old&c=3", 1, "a b&c") == f"{BASE}/?c=3&q=a+b%26c&p=1"
    assert feeds.imported_id(f"{BASE}/view/123abc", BASE) == "123"
    assert feeds.imported_id(f"{BASE}/download/9.torrent", BASE) == "9"
    assert [feeds.imported_id(x, BASE) for x in ("https://other.example/view/1", f"{BASE}/user/1", f"{BASE}/view/x", "ftp://feed.example/view/1")] == [None] * 4


LISTING = """<table class="torrent-list"><tbody>
<tr><td><a href="/?c=3">c</a></td><td><a class="comments" href="/view/11#comments">3</a><a href="/view/11" title="Full &amp; title">Short</a></td>
<td class="text-center"><a href="/download/11.torrent">d</a><a href="magnet:?xt=urn:btih:AB11&amp;dn=x">m</a></td><td class="text-center">2 MiB</td><td class="text-center" data-timestamp="1700000000">then</td></tr>
<tr><td><a href="/view/12">From text</a></td><td class="text-center">many</td><td data-timestamp="1700000001"></td></tr>
<tr><td><a href="/view/13" title="No time">x</a></td></tr><tr><td>nothing</td></tr></tbody></table><table><tbody><tr><td><a href="/view/99" title="other table">x</a></td></tr></tbody></table>"""


def test_listing_pages(spark):
    out = {r["external_id"]: r for r in pages.parse_listing(spark.createDataFrame([(LISTING,), ("",), (None,)], "html string"), "src", BASE).collect()}
    assert set(out) == {"11", "12"}
    one = out["11"]
    assert (one["title"], one["link"], one["info_hash"], one["torrent_url"], one["size_bytes"]) == ("Full & title", f"{BASE}/view/11", "ab11", f"{BASE}/download/11.torrent", 2097152)
    assert out["12"]["title"] == "From text" and out["12"]["size_bytes"] is None


DETAIL = """<h3 class="panel-title">The title</h3>
<div class="col-md-1">Information:</div><div class="col-md-5"><a href="https://info.example/x">info</a></div>
<div class="col-md-1">Date:</div><div class="col-md-5" data-timestamp="1700000000">then</div>
<div class="col-md-1">File size:</div><div class="col-md-5">3.0 KiB</div>
<div class="col-md-1">Info hash:</div><div class="col-md-5"><kbd>ABCDEF</kbd></div>
<a href="/download/5.torrent">t</a><a href="magnet:?xt=urn:btih:ABCDEF&amp;dn=x">m</a>
<div id="torrent-description">See https://anilist.co/manga/5 <b>now</b></div>
<div class="torrent-file-list"><ul><li><a class="folder">dir</a><ul><li><i></i>a v01.cbz <span class="file-size">(1 MiB)</span></li><li>b v02.cbz</li></ul></li></ul></div>
<div id="comments"><p>https://myanimelist.net/manga/9</p></div>"""


def test_detail_pages(spark):
    rows = [(1, DETAIL), (2, "<p>not found</p>"), (3, DETAIL.replace('<div id="torrent-description">See https://anilist.co/manga/5 <b>now</b></div>', '<p>https://anilist.co/manga/6</p>'))]
    out = {r["id"]: r for r in pages.parse_detail(spark.createDataFrame(rows, "id int, html string"), BASE).collect()}
    assert set(out) == {1, 3}
    one = out[1]
    assert (one["info_hash"], one["title"], one["torrent_url"], one["size_bytes"], one["information_url"]) == ("abcdef", "The title", f"{BASE}/download/5.torrent", 3072, "https://info.example/x")
    assert one["files"] == ["a v01.cbz", "b v02.cbz"] and one["magnet"] == "magnet:?xt=urn:btih:ABCDEF&dn=x"
    assert one["description_html"] == "See https://anilist.co/manga/5 <b>now</b>" and one["external_links"]["anilist"] == "https://anilist.co/manga/5"
    assert one["comment_suggested_links"]["mal"] == "https://myanimelist.net/manga/9" and one["external_links"]["mal"] is None
    assert out[3]["external_links"]["anilist"] == "https://anilist.co/manga/6" and out[3]["external_links"]["mal"] is None


def test_unseen_and_changed(spark):
    found = spark.createDataFrame([("1",), ("2",)], "external_id string")
    assert [r[0] for r in feeds.unseen(found, spark.createDataFrame([("1",)], "external_id string")).collect()] == ["2"]
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, etag string")
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, etag string")
    assert {r["path"] for r in feeds.changed_files(files, state).collect()} == {"b"}


def test_index_and_provider_files(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "i/1.json").write_text(json.dumps({"data": [{"id": "u1", "externalIds": [{"source": "plugin:manga_updates", "externalId": "x"}, {"source": "other", "externalId": "y"}], "localMaxVolume": 3.0}], "page": 1, "pageSize": 1, "total": 2}))
    (tmp_path / "i/2.json").write_text(json.dumps({"data": [{"id": "u2", "externalIds": [], "volumesOwned": 4}], "page": 2, "pageSize": 1, "total": 2}))
    rows = feeds.read_index(spark, str(tmp_path / "i")).orderBy("place").collect()
    assert [r["item"] for r in rows] == ["u1", "u2"] and [tuple(x) for x in rows[0]["ids"]] == [("mangaupdates", "x")] and rows[1]["volumes_owned"] == 4
    record = {"id": 7, "state": "active", "title": "T", "native_title": "N", "romanized_title": "T", "secondary_titles": {"en": [{"title": "S"}]}, "type": "oneshot", "status": "releasing", "rating": 81.0, "final_volume": "4.7", "source": {"my_anime_list": {"id": "5"}, "anilist": {"id": ""}}}
    (tmp_path / "p/a.json").write_text(json.dumps(record) + "\n{broken\n")
    (row,) = feeds.read_provider(spark, str(tmp_path / "p")).where("external_id is not null").collect()
    assert (row["kind"], row["status"], row["rating"], row["total_volumes"], row["alternate_titles"]) == ("one_shot", "ongoing", 8.1, 4, ["N", "S"])
    assert [tuple(x) for x in row["foreign_ids"]] == [("mal", "5")]


def test_index_is_read_up_to_its_total(spark, tmp_path):
    page = lambda n, items, total: json.dumps({"data": [{"id": i} for i in items], "page": n, "pageSize": 2, "total": total})
    for folder, pages in (("a", [(1, "ab", 3), (2, "c", 3), (3, "d", 3)]), ("b", [(1, "ab", 9), (2, "", 9), (3, "c", 9)]), ("c", [(1, "a", None), (2, "b", None)])):
        (tmp_path / folder).mkdir()
        for n, items, total in pages:
            (tmp_path / folder / f"{n}.json").write_text(page(n, items, total))
    got = {f: "".join(r["item"] for r in feeds.read_index(spark, f"{tmp_path}/{f}").orderBy("place").collect()) for f in "abc"}
    assert got == {"a": "abc", "b": "ab", "c": "ab"}


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/dump"
    assert snapshot.current(spark, path) is None
    assert snapshot.publish(spark.range(5).withColumn("state", F.lit("active")), path, least=3) == 5
    opened = snapshot.current(spark, path)
    with pytest.raises(snapshot.BrokenSnapshot):
        snapshot.publish(spark.range(2), path, least=3)
    assert snapshot.current(spark, path).count() == 5
    for n in (6, 7):
        snapshot.publish(spark.range(n), path, least=3)
        assert snapshot.current(spark, path).count() == n
        assert n == 7 or opened.count() == 5
    assert len([p for p in (tmp_path / "dump").iterdir() if p.name.startswith("version-")]) == 2


def test_lookups_in_a_dump(spark):
    dump = spark.createDataFrame([(1677, "active", "5", None), (9999, "merged", "5", "a"), (3, None, None, "b")], "id bigint, state string, source_mal_id string, source_anilist_id string")
    wanted = spark.createDataFrame([("1677",), ("9999",), ("x",), ("3",)], "external_id string")
    assert {r["id"] for r in snapshot.by_id(dump, wanted).collect()} == {1677, 3}


def test_change_feed_is_followed(spark, tmp_path):
    changes, target, state = (f"file://{tmp_path}/{x}" for x in ("changes", "target", "state"))
    kind = "id bigint, name string, updated_at bigint"
    tables = TableSet(spark, target)
    spark.createDataFrame([(1, "a", 5), (2, "hidden", 0), (1, "older", 3)], kind).coalesce(1).write.mode("append").parquet(changes)
    jobs.follow_changes(spark, changes, kind, tables, "rows", state).awaitTermination()
    spark.createDataFrame([(1, "late", 4), (3, "c", 6)], kind).coalesce(1).write.mode("append").parquet(changes)
    jobs.follow_changes(spark, changes, kind, tables, "rows", state).awaitTermination()
    assert {r["id"]: r["name"] for r in tables.read("rows").collect()} == {1: "a", 3: "c"}


def test_late_details(spark):
    now = 1_000_000
    rows = [(i, None if i % 2 else ["x"], now - i * 3600) for i in range(20)] + [(99, None, now - 100 * 3600)]
    releases = spark.createDataFrame(rows, "id int, files array<string>, observed_at bigint")
    tried = spark.createDataFrame([(1,)], "id int")
    assert [r["id"] for r in jobs.late_details(releases, tried, now).collect()] == [3, 5, 7, 9, 11]


def test_windowed_counts_and_first_sightings(spark, tmp_path):
    kind = "ts timestamp, source string, status string"
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(at(1, 0), "a", "ok"), (at(1, 30), "a", "ok"), (at(2, 5), "a", "bad"), (at(1, 59), "b", "ok")], kind).coalesce(1).write.parquet(f"{tmp_path}/runs")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/runs")
    for name, df, mode in (("counted", jobs.run_counts(stream), "complete"), ("sighted", jobs.first_sightings(stream, ["source", "status"], "ts"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    counted = {(r["window"]["start"].hour, r["source"], r["status"]): r["n"] for r in spark.table("counted").collect()}
    assert counted == {(1, "a", "ok"): 2, (2, "a", "bad"): 1, (1, "b", "ok"): 1}
    assert sorted((r["source"], r["status"]) for r in spark.table("sighted").collect()) == [("a", "bad"), ("a", "ok"), ("b", "ok")]
