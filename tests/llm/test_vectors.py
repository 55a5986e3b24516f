from __future__ import annotations

import numpy as np

from quillspark.llm import queries, vectors

KIND = "vec_id bigint, embedding array<float>"


def brute(rows, cosine, sets):
    """n_links and smallest reachable id by all pairs in double precision."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    for n, (i, v) in enumerate(good):
        for j, w in good[n + 1 :]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    return {i: (links[i], sets.root(i)) for i, _ in rows}


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir, sets):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = queries.op1_embedding_dedup(spark, sf_dir)
    assert found(out) == brute(rows, 0.95, sets)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())


def test_large_group_of_near_copies(spark, sets, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(24)
    rows = [(i, (base + 0.06 * rng.standard_normal(24)).tolist()) for i in range(150)]
    rows += [(i, rng.standard_normal(24).tolist()) for i in range(150, 250)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(vectors.link_vectors(spark.createDataFrame(rows, KIND))) == brute(rows, 0.95, sets)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, []), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [-1.0, 0.0])]
    out = found(vectors.link_vectors(spark.createDataFrame(rows, KIND)))
    assert out == {1: (2, 1), 2: (2, 1), 10: (2, 1)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11)}


def test_rows_of_one_id_are_different_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, -1.0]), (3, [0.0, -1.0]), (None, [1.0, 0.0])]
    out = sorted((tuple(r) for r in vectors.link_vectors(spark.createDataFrame(rows, KIND)).collect()), key=repr)
    assert out == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (None, 0, None, False)], key=repr)


def test_empty_table(spark):
    assert vectors.link_vectors(spark.createDataFrame([], KIND)).count() == 0


def test_chance_of_a_pair_at_the_threshold():
    plan = vectors.Tables.plan(1_000_000, 0.95)
    near = vectors.same_cell(vectors.WIDTH, (2 - 2 * 0.95) ** 0.5)
    assert (1 - near**plan.projections) ** plan.tables <= 2e-4
