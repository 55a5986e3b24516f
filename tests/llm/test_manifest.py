from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from quillspark.llm import manifest as m


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels of a list of digests, sixteen to a parent."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def steps(levels, at):
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield run[: at % 16], run[at % 16 + 1 :]
        at //= 16


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = [*steps(trees[s], i), *steps(top, n)]
            cur = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                cur = leaf_of(*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for a, b in path:
                cur = h("".join([*a, cur, *b]))
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, h("".join(x for a, b in path for x in a + b)), cur, cur == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (40, 40), (700, 3), (5000, 1)])
def test_against_brute_force(spark, n, sources):
    rows = [(i * 7, f"s{i % sources}" if i % 11 else f"s{i % 2 if sources > 1 else 0}", "en" if i % 3 else None, i, f"Text {i} Ä") for i in range(n)]
    assert rows_of(m.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_whole_table(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = rows_of(m.manifest(docs))
    assert got == brute(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_proofs_verify_and_no_other_leaf_does(spark, docs):
    for r in m.manifest(docs, proofs=True).where("doc_id % 9 = 0").collect():
        proof = [(s["at"], s["siblings"]) for s in r["proof"]]
        assert m.verify(r["leaf"], proof, r["root"]) and not m.verify(h(r["leaf"]), proof, r["root"])
        assert r["proof_sha256"] == h("".join(x for _, d in proof for x in d))


def test_odd_documents_and_an_empty_table(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    sized = odd_docs.withColumn("n_chars", F.length("text")).withColumn("pid", F.lit("x")).withColumn("leaf", F.lit("y"))
    rows = [tuple(r) for r in sized.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows += [(None, None, None, None, None)] * 2 + [(8, "", "de", None, ""), (8, "", None, 0, "")]
    more = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("x"))
    assert rows_of(m.manifest(more)) == brute(rows)
    empty = m.manifest(no_docs.withColumn("n_chars", F.lit(1)))
    assert empty.collect() == [] and empty.columns[:3] == ["doc_id", "source", "leaf"]


def test_equal_rows_are_split(spark):
    rows = [(5, "s", "en", 1, "x")] * 3000 + [(i, "s", "en", 1, "y") for i in range(10)]
    ordered = m.range_sorted(spark.createDataFrame(rows, SCHEMA).selectExpr("source as key", "doc_id"), ["key", "doc_id"])
    assert max(r["count"] for r in ordered.groupBy("pid").count().collect()) < 1500
    assert rows_of(m.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
