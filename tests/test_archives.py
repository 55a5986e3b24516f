"""Packed dumps and export files."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import tarfile
import warnings

import pytest
from pyspark.sql import functions as F

from quillspark.operators import export
from quillspark.sources import archives, snapshot

LINES = '{"id": 1, "title": "Ä"}\n\n{"id": 2}\nno json\n{"title": "without"}\n'


def pack(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, text in members:
            info = tarfile.TarInfo(name)
            if text is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(text.encode())
                tar.addfile(info, io.BytesIO(text.encode()))
    return hashlib.sha1(path.read_bytes()).hexdigest()


@pytest.mark.parametrize("mode", ["w:gz", "w", "w:xz"])
def test_first_member_is_read(spark, tmp_path, mode):
    digest = pack(tmp_path / "dump.tar", [("folder", None), ("a.jsonl", LINES), ("b.jsonl", '{"id": 9}')], mode)
    (tmp_path / "dump.tar.sha1").write_text(f"{digest.upper()}  dump.tar\n")
    assert archives.digest_of(spark, f"{tmp_path}/dump.tar") == digest
    with warnings.catch_warnings():
        warnings.simplefilter("error", archives.DigestWarning)
        rows = archives.load_dump(spark, f"{tmp_path}/dump.tar", "id bigint, title string").collect()
    assert sorted((r["id"], r["title"]) for r in rows) == [(1, "Ä"), (2, None)]


def test_wrong_or_missing_digests_warn_and_broken_content_fails(spark, tmp_path):
    path = f"{tmp_path}/dump.tgz"
    pack(tmp_path / "dump.tgz", [("a", LINES)])
    with pytest.warns(archives.DigestWarning, match="no digest"):
        assert archives.load_dump(spark, path, "id bigint").count() == 2
    (tmp_path / "dump.tgz.sha1").write_text("0" * 40)
    with pytest.warns(archives.DigestWarning, match="expected 0000"):
        assert archives.load_dump(spark, path, "id bigint").count() == 2
    with pytest.warns(archives.DigestWarning), pytest.raises(snapshot.BrokenSnapshot):
        archives.load_dump(spark, path, "id bigint", least=3)
    pack(tmp_path / "empty.tgz", [("folder", None)])
    with pytest.warns(archives.DigestWarning), pytest.raises(snapshot.BrokenSnapshot):
        archives.load_dump(spark, f"{tmp_path}/empty.tgz", "id bigint")


def test_a_dump_becomes_a_published_table_with_its_index(spark, tmp_path):
    lines = "\n".join(json.dumps({"id": i, "state": "merged" if i == 3 else "active", "source_mal_id": f"{i % 4}"}) for i in range(9))
    pack(tmp_path / "d.tgz", [("a", lines)])
    with pytest.warns(archives.DigestWarning):
        dump = archives.load_dump(spark, f"{tmp_path}/d.tgz", "id bigint, state string, source_mal_id string")
    snapshot.publish(dump, f"file://{tmp_path}/table", least=5)
    index = snapshot.by_source(snapshot.current(spark, f"file://{tmp_path}/table"), {"mal": "source_mal_id"})
    assert sorted((r["external_id"], r["id"]) for r in index.collect()) == [("0", 0), ("1", 1), ("2", 2), ("3", 7)]


def test_refreshes_keep_the_last_good_dump(spark, tmp_path):
    from quillspark.sources.tables import TableSet

    tables, target, path = TableSet(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}/target", tmp_path / "d.tgz"
    again = lambda n: archives.refresh(tables, n, "p", str(path), "id bigint", target, 100 + n, least=2)
    with pytest.warns(archives.DigestWarning):
        version = pack(path, [("a", LINES)])
        assert again(0) and not again(0)
        pack(path, [("a", '{"id": 5}')])
        assert again(1)
    assert sorted(r["id"] for r in snapshot.current(spark, target).collect()) == [1, 2]
    runs = {r["run"]: (r["status"], r["records"], r["error"]) for r in tables.read("provider_refreshes").collect()}
    assert runs == {"p/0": ("success", 2, None), "p/1": ("failure", None, "1 records, at least 2 expected")}
    assert [tuple(r) for r in tables.read("provider_cache_state").collect()] == [("p", 100, version, 2)]


ROWS = [(1, 'A, "b"', True, ["x", "y"]), (2, "C|d\ne", False, []), (3, None, None, None)]


@pytest.fixture
def series(spark):
    return spark.createDataFrame(ROWS, "id bigint, title string, owned boolean, genres array<string>")


def text(path, suffix=""):
    return [p.read_text() for p in sorted(path.glob(f"part-*{suffix}"))]


def test_csv_files(series, tmp_path):
    export.write_csv(series, ["id", "title", "genres"], f"{tmp_path}/csv")
    found = [row for part in text(tmp_path / "csv", ".csv") for row in csv.reader(io.StringIO(part))]
    assert [r for r in found if r[0] == "id"][0] == ["id", "title", "genres"]
    body = {r[0]: r for r in found if r[0] != "id"}
    assert set(body) == {"1", "2", "3"} and body["1"][1] == 'A, "b"' and body["2"][1] == "C|d\ne" and body["3"][1] == ""


def test_json_files_with_nested_releases(spark, series, tmp_path):
    releases = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "series_id bigint, name string, n int")
    export.write_json(series, ["id", "title", "owned"], f"{tmp_path}/json", releases)
    rows = {r["id"]: r for part in text(tmp_path / "json", ".json") for r in map(json.loads, part.splitlines())}
    assert rows[1] == {"id": 1, "title": 'A, "b"', "owned": True, "releases": [{"name": "a", "n": 1}, {"name": "b", "n": 2}]}
    assert rows[3] == {"id": 3, "title": None, "owned": None, "releases": None}


def test_markdown_files(series, tmp_path):
    export.write_markdown(series.select("id", "title"), ["id", "title"], f"{tmp_path}/md")
    lines = [x for part in text(tmp_path / "md", ".txt") for x in part.splitlines()]
    assert sorted(lines) == sorted(["| id | title |", "| --- | --- |", '| 1 | A, "b" |', "| 2 | C\\|d e |", "| 3 |  |"])


def test_selection():
    assert export.selection(["b"], ["title", "a", "b"]) == ["title", "b"]
    assert export.selection(None, ["title", "a"]) == ["title", "a"] and export.selection([], ["title", "a"]) == ["title", "a"]
    assert export.selection(["nothing"], ["title", "a"]) == ["title"]


def test_spans_of_a_large_series_merge_in_parts(spark):
    from quillspark.operators import aggregates as ag

    spans = spark.range(200_000).selectExpr("1 as series_id", "cast((id * 7919) % 100000 * 3 as double) as start", "cast((id * 7919) % 100000 * 3 + id % 2 as double) as end")
    united = ag.union_of_spans(spans, ["series_id"])
    # every third number with its neighbour: gaps stay
    assert united.select(F.size("spans")).first()[0] == 100_000
    cells = spans.groupBy(F.floor("start")).count()
    assert cells.count() == 100_000
    close = ag.union_of_spans(spark.range(50_000).selectExpr("1 as k", "cast(id as double) / 2 as start", "cast(id as double) / 2 as end"), ["k"]).first()["spans"]
    assert [(s["start"], s["end"]) for s in close] == [(0.0, 24999.5)]


def test_percentiles_with_an_outlier(spark):
    from quillspark.operators import aggregates as ag

    rows = spark.range(20_000).selectExpr("case when id = 7 then 1e15 else cast(id as double) end as v", "id % 3 as k")
    values = sorted(r["v"] for r in rows.collect())
    got = ag.nearest_rank(rows, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (got["n"], got["p50"], got["p95"], got["max"]) == (20_000, values[9_999], values[18_999], 1e15)
    by = {r["k"]: r for r in ag.nearest_rank(rows, "v", {"p50": 0.5}, ["k"]).collect()}
    for k in range(3):
        mine = sorted(r["v"] for r in rows.where(f"k = {k}").collect())
        assert by[k]["p50"] == mine[int(0.5 * len(mine) + 0.5) - 1]
    assert ag.nearest_rank(rows.limit(0), "v", {"p50": 0.5}).first()["n"] == 0
