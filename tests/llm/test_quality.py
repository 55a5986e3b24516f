from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality as q
from quillspark.llm import queries


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, large):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    rows = queries.op11_quality(spark, large).collect()
    assert len(rows) == spark.read.parquet(f"{large}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == k] for k in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.75


def test_fit_minimises_the_loss_over_all_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.4, 1, (40, 3)), rng.normal(-0.4, 1, (30, 3))
    found = q.rank_pairs(good, bad)

    def loss(w):
        a, b = found.expand(good) @ w, found.expand(bad) @ w
        return np.mean([np.logaddexp(0, y - x) for x in a for y in b]) + q.PENALTY * w @ w

    least = loss(found.weights)
    for _ in range(50):
        assert loss(found.weights + rng.normal(0, 0.05, len(found.weights))) > least


def test_quantile_lies_between_neighbours():
    values, ones = np.array([5.0, 1.0, 3.0, 2.0]), np.ones(4)
    assert q.weighted_quantile(values, ones, 0.25) == 1.5 and q.weighted_quantile(values, ones, 0.5) == 2.5
    assert q.weighted_quantile(values, np.array([1.0, 6.0, 1.0, 2.0]), 0.6) == 1.5
    assert q.weighted_quantile(values, ones, 1.0) == 5.0


def test_features_read_whole_texts():
    flat = "word " * 1000
    assert q.features(flat) != q.features(flat + "THE END !! ### !!")
    assert q.features(None) == q.features("") == q.features(" \n\t ") == [0.0] * len(q.FEATURES)
    assert all(np.isfinite(q.features(t)).all() for t in ("a", "!!", "퟿\U0001f600", "x" * 100_000, " | ", "　a"))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 7)] * 2 + [(None, 1, "y"), (4, 1, None), (3, None, "z"), (99, 0, "z"), (2, 7, "z")], "doc_id bigint, quality int, text string")
    out = q.rate_documents(odd_docs.withColumnRenamed("h", "quality_score"), labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["quality_score"] <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault((r["text"] or "").strip(), set()).add(r["quality_score"])
    assert all(len(s) == 1 for s in by.values())
    assert q.rate_documents(no_docs, labels).collect() == []
    for nothing in (labels.limit(0), labels.where("quality = 1")):
        assert {r["quality_score"] for r in q.rate_documents(odd_docs, nothing).collect()} == {q.CUTOFF}
        assert q.keep_good(odd_docs, nothing).count() == odd_docs.count()
    assert q.keep_good(odd_docs, labels).columns == odd_docs.columns


def test_fit_takes_all_labelled_rows(spark):
    draw = np.random.default_rng(7)
    words = np.array(["the", "meeting", "of", "ABC", "!!", "12", "x9#", "harbour", "a"])
    texts = [" ".join(draw.choice(words, draw.integers(3, 12), p=p / p.sum())) for i in range(7600) for p in [np.where(np.arange(9) % 4 == 3, 1 + (i < 3400), 2.0)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 3400).cast("int").alias("quality"))
    found = q.fit(docs, labels)
    x = found.expand(np.array([q.features(t) for t in texts]))
    bad, good = x[:3400], x[3400:]
    # at the least loss over all pairs its slope is zero
    p = 1 / (1 + np.exp((good @ found.weights)[:, None] - (bad @ found.weights)[None, :]))
    slope = (bad.T @ p.sum(0) - good.T @ p.sum(1)) / p.size + 2 * q.PENALTY * found.weights
    assert np.abs(slope).max() < 1e-6
    below = np.sum(x @ found.weights < found.cutoff)
    assert abs(below - 3400) <= 7600 * 0.01 and np.sum(np.abs(x @ found.weights - found.cutoff) < 1e-9) == 0


def test_quantiles_of_a_table(spark):
    draw = np.random.default_rng(3)
    groups = {0: np.round(draw.exponential(1, 900), 2), 1: np.concatenate([np.zeros(500), 10.0 ** draw.uniform(-30, 9, 400)]), 2: np.ones(7)}
    rows = spark.createDataFrame([(of, float(v), 1.0) for of, vs in groups.items() for v in vs], "of int, value double, weight double")
    shares = [0.005, 0.3, 0.5, 0.9, 0.995, 1.0]
    got = q.quantiles(rows, dict.fromkeys(groups, shares))
    for of, values in groups.items():
        distinct = np.unique(values)
        for share in shares:
            at = np.sort(values)[int(np.ceil(share * len(values) - 1e-6)) - 1]
            assert got[of, share] == (at, distinct[min(np.searchsorted(distinct, at) + 1, len(distinct) - 1)]), (of, share)
