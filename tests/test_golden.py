"""Worked cases of spans, titles, formats, ids, values, search and coverage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import ids, spans, titles, values
from quillspark.functions.similarity import best_dice, dice
from quillspark.operators import aggregates, merges, search

SPAN_CASES = [
    (["X v01-05 (Digital).cbz"], "", [(1, 5)], []),
    (["X v01-04", "X v06-09"], "", [(1, 4), (6, 9)], []),
    (["X v01-04", "X v05-09"], "", [(1, 9)], []),
    (["X c001", "X c012"], "", [], [(1, 1), (12, 12)]),
    (["c010", "c010.5", "c011"], "", [], [(10, 11)]),
    (["X v01-03 c001-050"], "", [(1, 3)], [(1, 50)]),
    (None, "X v001-111 + 1134-1176 (2003-2026)", [(1, 111)], [(1134, 1176)]),
    (None, "Name - Chapter 90 [C0045813].zip", [], [(90, 90)]),
    (None, "X 100 v01-16", [(1, 16)], []),
    (None, "X, Volumes 1 - 7, Parts 1-198", [(1, 7)], []),
    (None, "X v18 - v22", [(18, 22)], []),
    (["X v18 - 1935-A name"], "", [(18, 18)], []),
    (["X ch 5 - 2019 Special"], "", [], [(5, 5)]),
]


def test_spans(spark):
    df = spark.createDataFrame([(i, f, t) for i, (f, t, _, _) in enumerate(SPAN_CASES)], "i int, files array<string>, title string")
    out = {r["i"]: r["s"] for r in df.select("i", spans.detect_spans(F.col("files"), F.col("title")).alias("s")).collect()}
    for i, (_, _, volumes, chapters) in enumerate(SPAN_CASES):
        assert [tuple(s) for s in out[i]["volumes"]] == volumes and [tuple(s) for s in out[i]["chapters"]] == chapters, SPAN_CASES[i]


def merged(given):
    out = []
    for a, b in sorted((min(s), max(s)) for s in given):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def test_merged_spans(spark):
    import random

    draw = random.Random(4)
    rows = [[(6, 9), (1, 4), (4, 5)], [(9, 6), (4, 1)], [], [(1, 1), (1, 1)], [(0.5, 2), (3, 3.25), (4.5, 5)]]
    rows += [[(draw.randint(0, 30), draw.randint(0, 30)) if draw.random() < 0.3 else (a := draw.randint(0, 60), a + draw.randint(0, 3)) for _ in range(draw.randint(1, 25))] for _ in range(200)]
    rows = [[(float(a), float(b)) for a, b in r] for r in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s array<struct<start:double,end:double>>")
    out = {r["i"]: [tuple(s) for s in r["m"]] for r in df.select("i", spans.merge_spans(F.col("s")).alias("m")).collect()}
    assert out == {i: merged(r) for i, r in enumerate(rows)}
    (none,) = spark.sql("select cast(null as array<struct<start:double,end:double>>) s").select(spans.merge_spans(F.col("s")).alias("m")).collect()
    assert none["m"] is None


def test_spans_as_json(spark):
    texts = ['[{"start":1.0,"end":2.0}]', '{"start":1.0,"end":3.0}', "garbage", None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spans.from_json(F.col("t")).alias("s"))
    rows = {r["i"]: r for r in df.select("i", "s", spans.to_json(F.col("s")).alias("j")).collect()}
    assert [[tuple(s) for s in rows[i]["s"]] for i in range(5)] == [[(1, 2)], [(1, 3)], [], [], []]
    assert rows[0]["j"] == texts[0] and rows[2]["j"] is None


def test_dice_and_accents(spark):
    pairs = [("Name", "Name", 1.0), ("A b-C", "abc", 1.0), ("", "", 1.0), ("", "abc", 0.0), ("a", "b", 1.0), ("É x", "é x", 0.0)]
    out = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", dice(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r["i"]: r["d"] for r in out} == {i: d for i, (_, _, d) in enumerate(pairs)}
    (row,) = spark.range(1).select(best_dice(F.lit("abc"), F.array().cast("array<string>")).alias("none"), best_dice(F.lit("abc"), F.array(F.lit("xyz"), F.lit("ABC"), F.lit(None))).alias("best")).collect()
    assert row["none"] == 0.0 and row["best"] == 1.0


CLEAN_CASES = [
    ("Mob Psycho 100", [("Mob Psycho 100", 1.0), ("Mob Psycho", 0.9)]),
    ("Akira 2", [("Akira 2", 1.0)]),
    ("Name 009-050 as v02-06", [("Name", 1.0)]),
    ("AC/DC", [("AC/DC", 1.0)]),
    ("TITAN - A Novel", [("TITAN - A Novel", 1.0), ("TITAN", 0.9)]),
    ("(Digital) (Raw)", [("(Digital) (Raw)", 1.0)]),
    ("Bb | Aaa", [("Aaa", 1.0), ("Bb", 1.0)]),
]


def test_cleaned_titles_in_order(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN_CASES)], "i int, t string").select("i", titles.clean_title(F.col("t")).alias("c"))
    out = {r["i"]: r["c"] for r in df.collect()}
    for i, (_, want) in enumerate(CLEAN_CASES):
        assert [(q["text"], round(q["weight"], 3)) for q in out[i]["queries"]] == want
    assert "empty_fallback" in out[5]["rules"]


def test_ranges(spark):
    cases = [(None, 86400), ("", 86400), ("garbage", 86400), ("24h", 86400), ("7d", 604800), ("30m", 1800), ("1s", 60), ("52w", 7776000), ("-3h", 60), ("h", 86400), ("9223372036854775807w", 86400), ("1x", 86400), (" 2H ", 7200)]
    out = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", values.range_seconds(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in out} == {i: s for i, (_, s) in enumerate(cases)}
    rows = spark.createDataFrame([(86400, None), (86400, 1), (86400, 1000), (100, 7)], "s bigint, n int").select(values.bucket_width(F.col("s"), F.col("n")).alias("w")).collect()
    assert [r["w"] for r in rows] == [3600, 21600, 515, 15]


def test_accented_queries_meet_the_index(spark):
    df = spark.createDataFrame([(1, "Pokémon Adventures"), (2, "Pokemon Adventures"), (3, "Other")], "id int, title string")
    for query in ("Pokémon", "pokemon adv", "POKÉ"):
        assert {r["id"] for r in df.where(search.text_match(search.tokens(F.col("title")), query)).collect()} == {1, 2}
    assert {r["id"] for r in df.where(search.phrase_match(search.tokens(F.col("title")), "pokémon-adventures")).collect()} == {1, 2}
    assert search.query_tokens("Ünï-cödé 12") == ["uni", "code", "12"] and search.query_tokens(" -- ") == []
    assert search.relevance(df, "title", " - ").count() == 0


def test_coverage_of_series_without_releases(spark):
    kind = "array<struct<start:double,end:double>>"
    series = spark.createDataFrame([(1, None, None, 5), (2, None, None, 5), (3, [(1.0, 2.0)], None, 5)], f"id int, volumes {kind}, chapters {kind}, updated_at bigint")
    releases = spark.createDataFrame([(1, [(1.0, 2.0)], None, 10, 20), (1, None, None, 30, 7), (3, [(2.0, 1.0)], None, 1, 1)], f"series_id int, volume_span {kind}, chapter_span {kind}, observed_at bigint, posted_at bigint")
    out = {r["id"]: r for r in aggregates.recompute_coverage(series, releases, 99).collect()}
    assert (out[2]["last_discovered_at"], out[2]["last_release_at"], out[2]["changed"], out[2]["updated_at"]) == (None, 0, False, 5)
    assert (out[1]["last_discovered_at"], out[1]["last_release_at"], out[1]["changed"], out[1]["updated_at"]) == (30, 20, True, 99)
    assert (out[3]["changed"], out[3]["updated_at"]) == (False, 5)


@pytest.mark.parametrize("values_", [[5.0], [1.0, 1.0, 1.0], list(map(float, range(1, 101))), [0.5, 1e9, 2.0, 3.0, 3.0, 3.0]])
def test_nearest_rank(spark, values_):
    df = spark.createDataFrame([(v, "a") for v in values_] + [(None, "a"), (7.0, "b")], "v double, k string")
    n, ordered = len(values_), sorted(values_)
    want = {p: ordered[max(1, int(p * n + 0.5)) - 1] for p in (0.5, 0.95)}
    (row,) = aggregates.nearest_rank(df.where("k = 'a'"), "v", {"p50": 0.5, "p95": 0.95}, buckets=8).collect()
    assert (row["n"], row["p50"], row["p95"], row["max"]) == (n, want[0.5], want[0.95], ordered[-1])
    by = {r["k"]: r for r in aggregates.nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95}, ["k"], buckets=8).collect()}
    assert (by["a"]["p50"], by["a"]["p95"], by["b"]["p50"], by["b"]["n"]) == (want[0.5], want[0.95], 7.0, 1)
    (none,) = aggregates.nearest_rank(df.where("false"), "v", {"p50": 0.5}).collect()
    assert (none["n"], none["p50"], none["max"]) == (0, None, None)


def test_run_summary_window(spark):
    runs = spark.createDataFrame([(1, "a", 100, "success", 5), (2, "a", 110, "success", 2), (3, "a", 120, "failure", None), (4, "a", 130, "success", 7), (5, "a", 10, "success", 9)], "id int, source string, started_at bigint, status string, fetched bigint")
    (row,) = aggregates.run_summary(runs, "source", ["fetched"], 100, 200).collect()
    assert (row["runs"], row["successes"], row["failures"], row["fetched_sum"], row["last_started_at"], row["last_status"]) == (4, 3, 1, 14, 130, "success")


def test_feed_only_write_keeps_details(spark):
    kind = "source_kind string, external_id string, title string, files array<string>, seen bigint"
    stored = spark.createDataFrame([("feed", "1", "old", ["a"], 1), ("feed", "2", "old", None, 1)], kind)
    found = spark.createDataFrame([("feed", "1", "new", None, 2), ("feed", "2", "new", ["b"], 2), ("feed", "3", "new", None, 2)], kind)
    out = {r["external_id"]: tuple(r)[2:] for r in merges.upsert_releases(stored, found, ["title"], ["files"]).collect()}
    assert out == {"1": ("new", ["a"], 1), "2": ("new", ["b"], 1), "3": ("new", None, 2)}


def test_ids_of_links(spark):
    cases = [
        ("https://mangadex.org/title/0a1b-2c/name", ("mangadex", "0a1b-2c")),
        ("https://www.mangaupdates.com/series.html?id=123&x=1#x", ("mangaupdates-legacy", "123")),
        ("https://www.mangaupdates.com/series/abc123/name", ("mangaupdates", "abc123")),
        ("https://example.org/x", None),
    ]
    out = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string").select("i", ids.detect(F.col("u")).alias("d")).collect()
    assert {r["i"]: r["d"] and tuple(r["d"]) for r in out} == {i: d for i, (_, d) in enumerate(cases)}
