from __future__ import annotations

from quillspark.llm import mixing, queries

LEAVES = "domain string, language string, source string, tokens bigint"


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 10), ("d1", "en", "b", 1000), ("d2", "en", "c", 1000)], LEAVES)
    quota = {r["source"]: r["quota"] for r in mixing.leaf_quotas(leaves, {}, 400).collect()}
    assert quota == {"a": 10, "b": 190, "c": 200}


def test_full_domain_hands_on_to_the_others(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 10), ("d1", "de", "b", 20), ("d2", "en", "c", 1000)], LEAVES)
    quota = {r["source"]: r["quota"] for r in mixing.leaf_quotas(leaves, {"domain": {"d1": 3, "d2": 1}}, 400).collect()}
    assert quota == {"a": 10, "b": 20, "c": 370}


def test_weights_epochs_and_zero(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 100), ("d1", "de", "b", 100), ("d2", "en", "c", 100)], LEAVES)
    quota = {r["source"]: r["quota"] for r in mixing.leaf_quotas(leaves, {"domain": {"d2": 0}, "language": {"en": 3}}, 240, max_epochs=2).collect()}
    assert quota == {"a": 180, "b": 60}


def test_prefix_fits_and_is_as_long_as_can_be(spark, sf_dir):
    rows = queries.op10_mixing(spark, sf_dir).collect()
    used = {}
    for r in rows:
        leaf = (r["domain"], r["language"], r["source"])
        used[leaf] = used.get(leaf, 0) + r["n_tokens"] * r["copies"]
        assert used[leaf] <= r["quota"]


def test_odd_documents(odd_docs, no_docs):
    out = mixing.mix_documents(odd_docs, {}, 1.0)
    told = odd_docs.where("doc_id is null or doc_id not in (1, 3)")  # these two are leaves without any token
    assert out.columns == odd_docs.columns and out.count() == told.count()
    some = mixing.mix_documents(odd_docs.where("doc_id < 5"), {}, 0.5)
    assert some.where("doc_id = 4").count() in (0, 2)  # repeated rows share their place
    twice = mixing.mix_documents(odd_docs, {}, 2.0, max_epochs=2)
    assert twice.count() == 2 * told.count()
    assert mixing.mix_documents(no_docs, {}, 1.0).count() == 0
    assert mixing.mix(no_docs, {}, 1.0).count() == 0
