from __future__ import annotations

import numpy as np
import pytest

from quillspark.llm import queries
from quillspark.llm import whitening as w


def brute(vectors, k=16):
    """n, exact deviations, whitened (up to signs) and explained shares by an eigendecomposition."""
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = np.maximum(e[::-1], 0), v[:, ::-1]
    away = n * x - sums
    return n, (away**2).sum(axis=1), (away / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(rows, vectors):
    n, deviation, z, explained = brute(vectors)
    assert {r["n"] for r in rows} == {n}
    assert [r["deviation"] for r in rows] == deviation.tolist()
    got = np.array([r["whitened"] for r in rows])
    assert np.abs(got * np.sign((got * z).sum(axis=0)) - z).max() < 1e-9
    assert np.allclose(rows[0]["explained"], explained, rtol=1e-9) and rows[0]["identity_error"] < 1e-9


def test_query_equals_brute_force(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    rows = queries.op12_whitening(spark, sf_dir).orderBy("vec_id", "component").collect()
    assert len(rows) == 16 * len(given) and [r["component"] for r in rows[:16]] == list(range(1, 17))
    joined = [{**rows[i].asDict(), "whitened": [r["whitened"] for r in rows[i : i + 16]], "explained": [r["explained"] for r in rows[i : i + 16]]} for i in range(0, len(rows), 16)]
    check(joined, [r["embedding"] for r in given])


def test_repeated_vectors_many_partitions_and_a_tree(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(600, 20)) * np.linspace(0.2, 9, 20)).round(3).tolist()
    vectors = vectors + vectors[:50] + [vectors[7]] * 300
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    check(w.whiten(df).orderBy("vec_id").collect(), vectors)
    x = df.select(w.whole(df["embedding"]).alias("x")).distinct()
    fits = [w.fit_whitening(x.repartition(p, "x"), 20) for p in (1, 40, 300)]
    for f in fits[1:]:
        assert f.n == fits[0].n == 600 and f.sums == fits[0].sums
        assert np.allclose(f.eigenvalues, fits[0].eigenvalues, rtol=1e-11) and np.allclose(f.vectors, fits[0].vectors, atol=1e-8)


def test_merging_keeps_all_dimensions():
    rng = np.random.default_rng(5)
    x = rng.integers(900_000, 1_100_000, size=(200, 12))
    merged = w.Summary.of(x[:3])
    for a, b in ((3, 4), (4, 90), (90, 200)):
        merged = merged.merge(w.Summary.of(x[a:b]))
    c = x - x.mean(axis=0)
    assert merged.n == 200 and merged.sums == x.sum(axis=0).tolist() and merged.scaled.shape == (12, 12)
    assert np.allclose(merged.scaled.T @ merged.scaled, c.T @ c, rtol=1e-10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 2.0]), (6, [inf, 1.0, 1.0]), (7, []), (8, [1.0]), (9, [1e300, 1.0, 1.0]), (10, [-3.0, 1.0, 0.25]), (11, [2.0, 9.0, -1.0]), (12, [0.0, 5.0, 7.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, x string, pid int")
    got = w.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "10", "11", "12", "None"]
    sound = [r[1] for r in rows if str(r[0]) in ("1", "10", "11", "12", "None")]
    by = {str(r["vec_id"]): r for r in got}
    check([by[str(r[0])] for r in rows if str(r[0]) in by], sound)
    # a flat direction: null there, the others are whitened
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i + (i % 3), 1.0]) for i in range(20)], "vec_id bigint, embedding array<double>")
    r = w.whiten(flat).first()
    assert r["whitened"][2] is None and r["explained"][2] == 0.0 and r["identity_error"] < 1e-9
    one = w.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, [None, None], [0.0, 0.0], None)]
    assert w.whiten(df.limit(0)).collect() == [] and w.whiten(df.where("vec_id in (3, 4)")).collect() == []


@pytest.mark.parametrize("big", [2.0**40, 2.0**45])
def test_large_entries_are_exact_or_null(spark, big):
    vectors = [[big, 1.0], [-big, 0.5], [0.0, 3.0]]
    got = w.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()
    x = [[int(64 * v) + 1_000_000 for v in row] for row in vectors]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert [r["deviation"] for r in got] == [v if v < 2**63 else None for v in want]
