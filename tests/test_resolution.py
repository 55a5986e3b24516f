"""Every branch of the resolution on hand-made releases."""

from __future__ import annotations

from quillspark.operators import merges, resolution

RELEASE = "id int, title string, files array<string>, links array<struct<provider:string,id:string>>, resolution_status string, resolution_path string"


def released(*rows):
    return [(i, t, f, l, "unresolved", None) for i, (t, f, l) in enumerate(rows, 1)]


def inputs(spark, releases):
    catalog = [
        (1, "Golden River", "manga"),
        (2, "Golden River", "novel"),
        (3, "Silver Mountain Road", "novel"),
        (4, "Copper Valley Evening Song", "manga"),
        (5, "Copper Valley Morning Song", "manga"),
        (6, "Iron Harbour", "manga"),
        (7, "Quiet Library", "novel"),
    ]
    mapping = [("mal", "m6", 600, "manga"), ("mal", "m3", 300, "novel"), ("mangaupdates", "new6", 600, "manga")]
    foreign = [("anilist", "a6", 6), ("anilist", "a7", 7)]
    return {
        "releases": spark.createDataFrame(releases, RELEASE),
        "mapping": spark.createDataFrame(mapping, "provider string, external_id string, series_id bigint, kind string"),
        "foreign": spark.createDataFrame(foreign, "provider string, external_id string, entry int"),
        "catalog": spark.createDataFrame(catalog, "entry int, title string, kind string"),
        "id_map": spark.createDataFrame([(6, "new6"), (8, None)], "legacy_id bigint, modern_id string"),
    }


def resolved(spark, *rows):
    outcomes, put_up = resolution.resolve(**inputs(spark, released(*rows)))
    return {r["id"]: (r["path"], r["status"], r["entry"], r["series_id"]) for r in outcomes.collect()}, {r["id"]: r for r in outcomes.collect()}, sorted((r["id"], r["entry"], r["reason"]) for r in put_up.collect())


def test_branches(spark):
    out, full, candidates = resolved(
        spark,
        ("whatever", ["x.cbz"], [("mal", "m6")]),  # 1 known id
        ("whatever", ["x.cbz"], [("mal", "m3")]),  # 2 known id of another kind: linked, but ambiguous
        ("whatever", ["x.cbz"], [("anilist", "a6")]),  # 3 foreign id
        ("whatever", ["x.cbz"], [("anilist", "a7")]),  # 4 foreign id of another kind
        ("Golden River v01", ["x.cbz"], []),  # 5 two titles, the kind decides
        ("Golden River v01", ["x.cbz", "x.epub"], []),  # 6 mixed formats: one candidate each
        ("Silver Mountain Road", ["x.cbz"], []),  # 7 nothing compatible: taken unfiltered, ambiguous
        ("Copper Valley", ["x.cbz"], []),  # 8 too little likeness: review
        ("Nothing Like This", ["x.cbz"], []),  # 9 no hit
        ("whatever", ["x.cbz"], [("mangaupdates-legacy", "6")]),  # 10 legacy id by the map
        ("whatever", ["x.cbz"], [("mangaupdates-legacy", "8"), ("anilist", "a6")]),  # 11 dead id, then another
        ("Golden River audiobook", [], []),  # 12 hint of the title
        ("whatever", ["x.cbz"], [("anilist", "a6"), ("mal", "m6")]),  # 13 known ids come first
    )
    assert out[1] == ("known_external_id", "resolved", None, 600) == out[10] == out[13]
    assert out[2] == ("known_external_id", "ambiguous", None, 300)
    assert out[3] == ("foreign_id_lookup", "resolved", 6, None) == out[11]
    assert out[4] == ("foreign_id_lookup", "ambiguous", 7, None)
    assert out[5] == ("fuzzy_title", "resolved", 1, None)
    assert out[6] == ("fuzzy_title", "review_pending", None, None)
    assert out[7] == ("fuzzy_title", "ambiguous", 3, None)
    assert out[8] == ("fuzzy_title", "review_pending", None, None)
    assert out[9][:2] == (None, "unresolved")
    assert [c[:2] for c in candidates if c[0] == 6] == [(6, 1), (6, 2)]
    assert [c[:2] for c in candidates if c[0] == 8] == [(8, 4), (8, 5)] and 0.55 <= full[8]["confidence"] < 0.85
    assert all(c[2].startswith("fuzzy_title:") for c in candidates) and {c[0] for c in candidates} == {6, 8}
    assert out[12][0] in ("fuzzy_title", None)


def test_second_pass_uses_what_the_first_found(spark):
    rows = released(("Iron Harbour v01", ["x.cbz"], []), ("unlike anything", ["x.cbz"], [("anilist", "a6")]), ("unlike anything else", ["x.cbz"], []))
    outcomes, _ = resolution.resolve_to_fixed_point(**inputs(spark, rows))
    out = {r["id"]: (r["status"], r["entry"]) for r in outcomes.collect()}
    assert out == {1: ("resolved", 6), 2: ("resolved", 6), 3: ("unresolved", None)}


def test_operator_decisions_stay(spark):
    rows = [(1, "t", None, [], "rejected", None), (2, "t", None, [], "standalone", None), (3, "t", None, [], "resolved", "manual"), (4, "t", None, [], "ambiguous", "fuzzy_title"), (5, "t", None, [], "unresolved", None)]
    releases = spark.createDataFrame(rows, RELEASE)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(resolution.open_releases(releases)) == [4, 5]
    assert ids(resolution.open_releases(releases, ["unresolved"])) == [5]
    assert ids(resolution.open_releases(releases, forced=True)) == [1, 2, 3, 4, 5]
    assert ids(resolution.open_releases(releases, ["rejected"], forced=True)) == [1]


def test_new_series_and_link_requests(spark):
    series = spark.createDataFrame([(5, "old", "manual", 1, None)], "id bigint, title string, metadata_source string, updated_at bigint, note string")
    located = spark.createDataFrame([("a", None, "A"), ("b", 5, "B"), ("c", None, "C"), ("c", None, "C")], "external_id string, series_id bigint, title string")
    out = {r["title"]: r for r in merges.insert_from_metadata(series, located, 9).collect()}
    assert set(out) == {"old", "A", "C"} and {out["A"]["id"], out["C"]["id"]} == {6, 7}
    assert (out["A"]["metadata_source"], out["A"]["updated_at"], out["A"]["note"]) == ("provider", 9, None)
    assert sorted(r["id"] for r in merges.insert_from_metadata(series.limit(0), located, 9).collect()) == [1, 2]
    requests = spark.createDataFrame([(1, 5, None, None), (2, 6, None, None), (3, None, "p", "x"), (4, None, "p", "y"), (5, None, "p", "z"), (6, 5, "p", "x"), (7, None, None, None), (8, None, "p", None)], "request int, series_id bigint, provider string, external_id string")
    mapping = spark.createDataFrame([("p", "x", 5)], "provider string, external_id string, series_id bigint")
    records = spark.createDataFrame([("p", "y")], "provider string, external_id string")
    out = {r["request"]: tuple(r)[1:] for r in merges.link_targets(requests, series, mapping, records).collect()}
    bad = (None, False, "bad_request")
    assert out == {1: (5, False, None), 2: (None, False, "not_found"), 3: (5, False, None), 4: (None, True, None), 5: (None, False, "no_record"), 6: bad, 7: bad, 8: bad}
