"""Assignment of provider records to series."""

from __future__ import annotations

import random

import pytest

from quillspark.operators import entities

RECORD = "place bigint, provider string, external_id string, foreign_ids array<struct<provider:string,id:string>>"
KNOWN = "provider string, external_id string, series_id bigint"


def brute(records, mapping):
    """Record after record: its own id, then foreign ids of series with room for it, else a new one."""
    by_id = {(p, e): s for p, e, s in mapping}
    held = {(s, p): e for p, e, s in mapping}
    out = {}
    for place, provider, own, foreign in sorted(records):
        foreign = foreign or []
        ids = [(provider, own), *foreign]
        found = by_id.get((provider, own))
        if found is None:
            found = next((by_id[i] for i in foreign if i in by_id and held.get((by_id[i], provider), own) == own), -place - 1)
        out[place] = found
        for p, e in ids:
            if (p, e) not in by_id and (found, p) not in held:
                by_id[p, e], held[found, p] = found, e
    return out, by_id


def assigned(spark, records, mapping):
    got, known = entities.assign(spark.createDataFrame(records, RECORD), spark.createDataFrame(mapping, KNOWN))
    one = lambda r: r["series_id"] if r["series_id"] is not None else -r["founder"] - 1
    found = {r["place"]: one(r) for r in got.collect()}
    ids = {(r["provider"], r["external_id"]): one(r) for r in known.collect()}
    return found, ids


def test_chain_over_two_providers_is_one_series(spark):
    records = [(1, "a", "1", [("k", "x")]), (2, "b", "2", [("k", "x"), ("m", "y")]), (3, "a", "1", [("m", "y")]), (4, "b", "9", [])]
    found, ids = assigned(spark, records, [("z", "0", 5)])
    assert found == {1: -2, 2: -2, 3: -2, 4: -5} == brute(records, [("z", "0", 5)])[0]
    assert ids["m", "y"] == ids["k", "x"] == ids["a", "1"] == ids["b", "2"] == -2 and ids["z", "0"] == 5


def test_a_second_id_of_a_provider_founds_its_own(spark):
    # 3 shares an id with the group of 1 and 2, which has an id of its provider; 4 shares one with 3
    records = [(1, "a", "1", [("k", "x")]), (2, "b", "2", [("k", "x"), ("m", "y")]), (3, "a", "7", [("m", "y"), ("n", "z")]), (4, "b", "8", [("n", "z")])]
    found, _ = assigned(spark, records, [])
    assert found == {1: -2, 2: -2, 3: -4, 4: -4} or found == {1: -2, 2: -2, 3: -5, 4: -5}
    assert len({found[1], found[3]}) == 2


def test_stored_series_are_joined_before_new_ones(spark):
    mapping = [("k", "x", 10), ("a", "1", 10), ("k", "w", 11)]
    records = [(1, "a", "2", [("k", "x")]), (2, "b", "5", [("k", "x"), ("k", "q")]), (3, "c", "6", [("k", "q")]), (4, "a", "3", [("k", "w")]), (5, "a", "4", [("k", "w")]), (6, "a", "3", None)]
    found, ids = assigned(spark, records, mapping)
    # 1 and 5 meet a series that has another id of their provider
    assert found == {1: -2, 2: 10, 3: -4, 4: 11, 5: -6, 6: 11} == brute(records, mapping)[0]
    assert ids["k", "q"] == -4  # the first series has an id of k


def test_a_very_frequent_id(spark):
    records = [(i, "a", f"r{i}", [("k", "hot")]) for i in range(300)] + [(300 + i, "b", f"s{i}", [("k", "hot"), ("m", f"{i}")]) for i in range(100)] + [(400 + i, "c", f"t{i}", [("m", f"{i}")]) for i in range(100)]
    assert assigned(spark, records, [])[0] == brute(records, [])[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_entities_without_conflicts_are_found_again(spark, seed):
    """Random records of known entities, each with one id a provider: every connected group is one series."""
    rng = random.Random(seed)
    records = []
    for place in rng.sample(range(1000), 150):
        entity, providers = rng.randrange(40), rng.sample("abcdef", 3)
        records.append((place, providers[0], f"{providers[0]}{entity}", [(p, f"{p}{entity}") for p in providers[1 : rng.randint(1, 3)]]))
    mapping = [("a", f"a{e}", 1000 + e) for e in range(0, 40, 7)]
    found, ids = assigned(spark, records, mapping)
    groups = {}
    for place, provider, own, foreign in records:
        groups.setdefault(found[place], set()).add(int(own[1:]))
        assert ids[provider, own] == found[place]
    assert all(len(g) == 1 for g in groups.values())
    # the connected groups by brute force
    label = {("s", s): ("s", s) for *_, s in mapping} | {("i", p, e): ("s", s) for p, e, s in mapping}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for place, provider, own, foreign in records:
        for p, e in [(provider, own), *foreign]:
            a, b = root(("r", place)), root(("i", p, e))
            if a != b:
                label[a] = b
    same = {}
    for place, *_ in records:
        same.setdefault(root(("r", place)), set()).add(found[place])
    assert all(len(s) == 1 for s in same.values())


def test_series_and_mapping_after_a_batch(spark):
    series = spark.createDataFrame([(3, "Old", "manual", 7)], "id bigint, title string, metadata_source string, updated_at bigint")
    records = spark.createDataFrame([(5, "a", "1", [("k", "x")], "One"), (9, "b", "2", [("k", "x")], "One again"), (7, "a", "4", [], "Two"), (8, "a", "0", [], "Old too")], RECORD + ", title string")
    made, known, assigned_to = entities.persist(series, spark.createDataFrame([("a", "0", 3)], KNOWN), records, 99)
    assert sorted(map(tuple, made.collect())) == [(3, "Old", "manual", 7), (4, "One", "provider", 0), (5, "Two", "provider", 0)]
    assert {r["place"]: r["series_id"] for r in assigned_to.collect()} == {5: 4, 9: 4, 7: 5, 8: 3}
    assert {(r["provider"], r["external_id"]): r["series_id"] for r in known.collect()} == {("a", "0"): 3, ("a", "1"): 4, ("k", "x"): 4, ("b", "2"): 4, ("a", "4"): 5}


def test_no_records(spark):
    empty = spark.createDataFrame([], RECORD)
    assert assigned(spark, [], [("a", "1", 2)]) == ({}, {("a", "1"): 2})
    got, _ = entities.assign(spark.createDataFrame([(1, None, "x", None), (2, "a", None, None)], RECORD), spark.createDataFrame([], KNOWN))
    assert got.collect() == [] and empty.count() == 0
