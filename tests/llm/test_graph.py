from __future__ import annotations

import random

from quillspark.llm.graph import comparison_blocks, connected_components


def test_components_of_chains_stars_and_noise(spark, sets):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 700)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(7, 7), (None, 3), (5, 4), (4, 5), (4, 5)]
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {x: sets.root(x) for x in list(sets.up)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_every_pair_of_a_bucket_meets(spark):
    rows = spark.range(100).selectExpr("0 as key", "id")
    dealt = comparison_blocks(rows, ["key"], "id", 16).collect()
    parts = {}
    for r in dealt:
        parts.setdefault((r["lo"], r["hi"]), set()).add(r["id"])
    assert all(any(a in p and b in p for p in parts.values()) for a in range(100) for b in range(a))
    assert max(map(len, parts.values())) < 60
