from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quillspark.llm import queries, sketch


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_edited_texts_and_likeness(spark, sf_dir, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    out = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, sf_dir).collect()}
    assert len(out) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[i]["n_chars"] == len(text)
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a = shingles(text)
        for other, got in ((edited, out[i]["near_edited"]), (after, out[i]["near_next"])):
            b = shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            small = len(a | b) <= sketch.K
            assert abs(true - got) <= (1e-9 if small else 0.15)
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, out[i]["fingerprint"]) == out[i]["fingerprint"]


def test_merge_containment_and_counts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    rows = [(" ".join(words), " ".join(words[:1500]))]
    df = spark.createDataFrame(rows, "a string, b string").select(*[sketch.bottom_k(sketch.shingle_hashes(F.col(c))).alias(c) for c in "ab"])
    a, b = F.col("a"), F.col("b")
    r = df.select(sketch.resemblance(a, b).alias("r"), sketch.containment(b, a).alias("c"), sketch.distinct_shingles(a).alias("n"), (sketch.merged(a, b) == a).alias("same")).first()
    assert abs(r["r"] - 0.5) < 0.12 and r["c"] > 0.85 and abs(r["n"] - 2996) < 500 and r["same"]


def test_groups_merge_to_the_sketch_of_the_whole(spark):
    rows = [("g", " ".join(f"{p}x{i}" for i in range(300))) for p in range(4)] + [("e", None)]
    docs = spark.createDataFrame(rows, "grp string, text string")
    (row,) = sketch.sketch_groups(docs, ["grp"]).collect()
    every = docs.where("grp = 'g'").select(F.explode(sketch.shingle_hashes(F.col("text"))).alias("h")).distinct().orderBy("h").limit(sketch.K)
    assert row["sketch"] == [r["h"] for r in every.collect()]


def test_following_keys(spark):
    keys = sorted({random.Random(2).randrange(-(10**12), 10**12) for _ in range(50)} | {1, 2, 3, 5000, -5000})
    out = {r["key"]: r["next"] for r in sketch.following(spark.createDataFrame([(k,) for k in keys], "key bigint")).collect()}
    assert out == dict(zip(keys, [*keys[1:], None]))
    ends = [-(2**63), -1, 0, 2**63 - 1]
    out = {r["key"]: r["next"] for r in sketch.following(spark.createDataFrame([(k,) for k in ends], "key bigint")).collect()}
    assert out == dict(zip(ends, [*ends[1:], None]))


def test_next_of_null_and_negative_ids(spark):
    rows = [(None, "b"), (None, "a"), (-(2**63), "c"), (-5, "d"), (3, "e"), (3, "f"), (2**63 - 1, "g")]
    out = sketch.with_next(spark.createDataFrame(rows, "i bigint, t string"), "i", ["t"])
    assert out.columns == ["i", "t", "next_t"]
    assert {r["t"]: r["next_t"] for r in out.collect()} == dict(zip("abcdefg", "bcdefga"))
    (alone,) = sketch.with_next(spark.createDataFrame([(None, "x")], "i bigint, t string"), "i", ["t"]).collect()
    assert alone["next_t"] == "x"


def test_odd_documents(odd_docs, no_docs):
    out = sketch.fingerprint_documents(odd_docs)
    assert out.count() == odd_docs.count()
    assert {r["n_chars"] for r in out.where("doc_id in (1, 2)").collect()} == {0}
    assert sketch.fingerprint_documents(no_docs).count() == 0
