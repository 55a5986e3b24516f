from __future__ import annotations

import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import langid, queries


def grams(text):
    """Hashed n-grams letter by letter."""
    low = text.lower()
    if not any(c.isalpha() for c in low):
        return Counter()
    line = [0]
    for c in low:
        p = ord(c) if c.isalpha() else 0
        if p or line[-1]:
            line.append(p)
    if line[-1]:
        line.append(0)
    out = Counter()
    for i in range(len(line) - langid.ORDER + 1):
        h = 0
        for p in line[i : i + langid.ORDER]:
            h = (h * 0x9E3779B1 & 0xFFFFFFFF) ^ p
        h = (h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF
        out[h >> 16 & langid.BUCKETS - 1] += 1
    return out


def mixture(like, shares, counts, rounds=15):
    """Expectation-maximisation in plain loops; ``like[language][bucket]``."""
    total = sum(counts.values())
    for _ in range(rounds):
        new = {x: 0.0 for x in shares}
        for g, n in counts.items():
            whole = sum(shares[x] * like[x][g] for x in shares)
            for x in shares:
                new[x] += n * shares[x] * like[x][g] / whole
        new = {x: max(v / total, 1e-12) for x, v in new.items()}
        norm = sum(new.values())
        new = {x: v / norm for x, v in new.items()}
        if max(abs(new[x] - shares[x]) for x in shares) < 1e-3:
            return new
        shares = new
    return shares


def brute(text, like):
    """Strongest language and its share."""
    counts = grams(text or "")
    if not counts:
        return "und", 0.0
    total = sum(counts.values())
    shares = mixture(like, {x: 1 / len(like) for x in like}, counts)
    order, best = sorted(shares, key=lambda x: (-shares[x], x)), None
    for k in range(1, len(order) + 1):
        norm = sum(shares[x] for x in order[:k])
        part = mixture(like, {x: shares[x] / norm for x in order[:k]}, counts) if k > 1 else {order[0]: 1.0}
        cost = -sum(n * math.log(sum(part[x] * like[x][g] for x in part)) for g, n in counts.items()) + (k - 1) / 2 * math.log(total + 1)
        if best is not None and cost >= best[0]:
            break
        best = (cost, part)
    return min(best[1].items(), key=lambda x: (-x[1], x[0]))


def test_query_equals_brute_force(spark, sf_dir, docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    learned = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] is not None and r["lang"] is not None:
            learned.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    like = {}
    for x, counts in learned.items():
        whole = sum(counts.values()) + 0.1 * langid.BUCKETS
        like[x] = [(counts[g] + 0.1) / whole for g in range(langid.BUCKETS)]
    out = {r["doc_id"]: r for r in queries.op3_language_id(spark, sf_dir).collect()}
    assert len(out) == len(rows)
    for r in rows:
        best, share = brute(r["text"], like)
        got = out[r["doc_id"]]
        assert got["lang_pred"] == best and abs(got["score"] - share) < 1e-6, r["doc_id"]


def test_held_out_accuracy_and_shape(spark, sf_dir, docs):
    out = queries.op3_language_id(spark, sf_dir)
    assert out.count() == docs.count()
    rows = out.join(docs.select("doc_id", "text", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0
    assert out.where("score < 0 or score > 1 or score is null").isEmpty()
    assert out.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").isEmpty()


def test_labels_of_held_out_rows_do_not_matter(docs):
    kept = lambda d: {r["doc_id"]: tuple(r["language"])[:2] for r in langid.identify(d).collect()}
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert kept(docs) == kept(changed)


def test_mixture_names_both_languages(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then it sleeps ", "der schnelle braune Fuchs springt ueber den faulen Hund und schlaeft "
    labelled = spark.createDataFrame([(i, t * 5, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de")] * 10)], "doc_id bigint, text string, lang string")
    model = langid.fit(labelled)
    best, score, named = model.predict(en * 6 + de * 3)
    assert best == "en" and {x for x, _ in named} == {"en", "de"} and 0.5 < score < 0.85
    assert model.predict(de)[0] == "de"


def test_odd_documents(spark, odd_docs, no_docs):
    out = {r["doc_id"]: r["language"] for r in langid.identify(odd_docs).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 5))
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {4, 6, None}
    filled = spark.createDataFrame([(1, "ein Wort und noch eins", None), (2, "a word and one more", "en"), (3, "ein Wort und noch eins", "de"), (4, "ein Wort", "xx")], "doc_id bigint, text string, lang string")
    assert {r["doc_id"]: r["lang"] for r in langid.keep_identified(filled.unionByName(filled.withColumn("doc_id", F.col("doc_id") + 100))).collect() if r["doc_id"] < 100}.items() >= {2: "en", 3: "de", 4: "xx"}.items()
    assert langid.keep_identified(no_docs).count() == 0
