from __future__ import annotations

from itertools import combinations

import pytest
import xxhash

from quillspark.llm import queries, simhash


def plain_simhash(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("distance", range(8))
def test_position_sets_lose_nothing(distance):
    sets = [set(s) for s in simhash.position_sets(distance)]
    assert all(any(s <= set(equal) for s in sets) for equal in combinations(range(8), 8 - distance))


def test_query_equals_brute_force(spark, sf_dir, docs, sets):
    prints = {r["doc_id"]: plain_simhash(r["text"]) for r in docs.select("doc_id", "text").collect()}
    for (i, a), (j, b) in combinations(sorted(prints.items()), 2):
        if (a ^ b).bit_count() <= 4:
            sets.join(i, j)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, sf_dir).collect()}
    assert out == {i: (f"{p:016x}", sets.root(i)) for i, p in prints.items()}


def test_random_fingerprints_with_chains(spark, sets):
    import random

    rng = random.Random(5)
    prints = []
    for _ in range(30):
        p = rng.getrandbits(64)
        for _ in range(8):
            prints.append(p)
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
    prints = list(dict.fromkeys(prints))
    for (i, a), (j, b) in combinations(enumerate(prints), 2):
        if (a ^ b).bit_count() <= 4:
            sets.join(i, j)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    out = {r["node"]: r["component"] for r in simhash.near_components(spark.createDataFrame(signed, "node bigint, fp bigint")).collect()}
    assert {i: out.get(i, i) for i in range(len(prints))} == {i: sets.root(i) for i in range(len(prints))}


def test_odd_documents(odd_docs, no_docs):
    out = simhash.simhash_documents(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] == 4} == {4}
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert simhash.drop_near_copies(no_docs).count() == 0


def test_null_and_repeated_ids_keep_clean_documents(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(1, say("a")), (None, say("b")), (None, say("c")), (None, say("a")), (2, say("d")), (2, say("e")), (3, say("e")), (4, say("d")), (None, say("b"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"] or 0), r["text"]) for r in simhash.drop_near_copies(df).collect())
    assert kept == sorted([(1, say("a")), (0, say("b")), (0, say("c")), (2, say("d")), (2, say("e"))])
