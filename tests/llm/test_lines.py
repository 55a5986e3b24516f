from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import lines, queries


def normal(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)} if len(line) >= 8 else {line}


def similar_pairs(texts):
    """All pairs of similar lines: candidates share a shingle, each compared exactly."""
    of = {t: shingles(t) for t in texts}
    having = defaultdict(list)
    for t, s in of.items():
        for x in s:
            having[x].append(t)
    seen = set()
    for group in having.values():
        for n, a in enumerate(group):
            for b in group[:n]:
                pair = (a, b) if a < b else (b, a)
                if pair not in seen:
                    seen.add(pair)
                    both = len(of[a] & of[b])
                    if both >= 0.8 * (len(of[a]) + len(of[b]) - both):
                        yield pair


def brute(rows, sets):
    """Lines that go by all pairs: {(doc, line number)}."""
    placed = [(i, n, normal(x)) for i, text in rows for n, x in enumerate((text or "").split("\n")) if normal(x)]
    for a, b in similar_pairs({t for _, _, t in placed}):
        sets.join(a, b)
    kept, gone = set(), set()
    for i, n, t in sorted(placed):
        root = sets.root(t)
        (gone.add((i, n)) if root in kept else kept.add(root))
    return gone


def test_query_against_all_pairs(spark, sf_dir, docs, sets):
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], sets)
    out = queries.op7_line_dedup(spark, sf_dir).collect()
    got = {(r["doc_id"], int(n)) for r in out for n in r["dropped_lines"].split(",") if n}
    assert len(out) == docs.count()
    assert got <= want
    assert len(got) >= 0.98 * len(want) > 0


def keys_of(spark, texts):
    """Band keys of each normalised line."""
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, line string")
    return {r["i"]: {v for k, v in r.asDict().items() if k != "i" and v is not None} for r in lines.with_keys(df).collect()}


def test_similarity_is_exact(spark):
    base = "the meeting of the harbour council was moved to the second week of october because of rain"
    texts = [base[:k] + "zq" + base[k + n :] for k in range(0, 80, 3) for n in (0, 2, 5)] + [base, "short", "shorts", "x" * 40, "x" * 9, "ça été où 日本語テキスト", "ça été où 日本語テキスト!"]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    both = df.select(F.col("line").alias("a")).crossJoin(df.select(F.col("line").alias("b")))
    rows = both.select("a", "b", lines.similarity(lines.shingle_hashes(F.col("a")), lines.shingle_hashes(F.col("b"))).alias("s")).collect()
    assert all(abs(r["s"] - len(shingles(r["a"]) & shingles(r["b"])) / len(shingles(r["a"]) | shingles(r["b"]))) < 1e-12 for r in rows)


def test_normal_lines_are_trimmed_of_all_spaces(spark):
    texts = ["", " ", "\t \r\x0b\x0c", "A b", " A b", "A b\r", "\x0c\tÇa  É\x0b ", "\u00a0A\u00a0", "\u2003x", "日本 ", "\r日本語\t\t", "a\tb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    got = {r["i"]: r["line"] for r in rows.select("i", lines.normal_line(F.col("text")).alias("line")).collect()}
    assert got == {i: normal(t) for i, t in enumerate(texts)}
    assert {r["id"] for r in lines._lines(rows, "i", "text").collect()} == {i for i, t in enumerate(texts) if normal(t)}


def similar_pair(draw, length):
    """A random line of about a length and an edited one, similarity 0.8 or little more."""
    while True:
        a = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(length)).strip()
        b = a
        for _ in range(60):
            at = draw.randrange(len(b) + 1)
            c = b[:at] + draw.choice(["", "7", "q", " (3)"]) + b[at + draw.randrange(2) :]
            if not c.strip() or len(shingles(a) & shingles(c)) < 0.8 * len(shingles(a) | shingles(c)):
                break
            b = c
        if a != b and b == b.strip() and len(shingles(a) & shingles(b)) <= 0.88 * len(shingles(a) | shingles(b)):
            return a, b


def test_recall_near_the_threshold_by_length(spark):
    draw = random.Random(11)
    for low, high in ((14, 20), (20, 30), (30, 45), (45, 80), (80, 150), (150, 400), (400, 900)):
        pairs = [similar_pair(draw, draw.randint(low, high)) for _ in range(300)]
        keys = keys_of(spark, [t for p in pairs for t in p])
        met = sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs)))
        assert met >= 0.97 * len(pairs), (low, high, met)


def test_repeated_shingles_count_once(spark):
    a = ["=" * 9, "=-" * 8, "ha " * 40, "na na na na batman " * 30, "ab" * 5]
    b = ["=" * 200, "=-" * 90, "ha " * 47, "na na na na batman " * 33, "ab" * 300]
    keys = keys_of(spark, [t.strip() for t in a + b])
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = shingles(x.strip()), shingles(y.strip())
        assert len(x & y) < 0.8 * len(x | y) or keys[i] & keys[i + len(a)], i


def test_fine_sketches_refuse_no_similar_pair(spark):
    base = "the meeting of the harbour council was moved to the second week of october because of rain"
    texts = [base[:k] + "zq" + base[k + n :] for k in range(0, 80, 3) for n in (0, 2, 5, 9)] + [base, "short", "shorts", "x" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "h bigint, line string")
    s = {r["h"]: r["sketch"] for r in lines.fine_sketches(df).collect()}
    assert {h: x["n"] for h, x in s.items()} == {h: len(shingles(t)) for h, t in enumerate(texts)}
    rows = spark.createDataFrame([(a, b, s[a], s[b]) for a in s for b in s], "a bigint, b bigint, sa " + (kind := df.transform(lines.fine_sketches).schema["sketch"].dataType.simpleString()) + ", sb " + kind)
    may = {(r["a"], r["b"]): r["may"] for r in rows.select("a", "b", lines.may_be_similar("sa", "sb", lines.FINE).alias("may")).collect()}
    same = {(a, b) for a in s for b in s if (n := len(shingles(texts[a]) & shingles(texts[b]))) >= 0.8 * (len(shingles(texts[a])) + len(shingles(texts[b])) - n) - 1e-9}
    assert all(may[p] for p in same) and not all(may.values())


def test_edited_lines_and_places(spark):
    long = "All visitors are asked to leave their umbrellas at the entrance of the museum before two."
    rows = [(1, f"{long}\nunique line one here"), (2, f"first\n\n{long.upper()}  \nend of two"), (3, long.replace("two", "ten") + "\n"), (4, "first"), (5, "\n \n\t\n"), (6, None)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: (r["text"], r["gone"]) for r in out.collect()} == {
        1: (rows[0][1], None), 2: ("first\n\nend of two", [2]), 3: ("", [0]), 4: ("", [0]), 5: (rows[4][1], None), 6: (None, None),
    }


def test_lines_that_differ_by_a_date_number_or_suffix(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    pairs = []
    for n in range(3, 40):
        for _ in range(8):
            line = " ".join(draw.sample(words, n))
            for edited in (line + " (2023-11-04)", "12:30 " + line, line + " [1, 2, 3]", line + ".", line[: len(line) // 2] + "7" + line[len(line) // 2 :], line[:-3]):
                a, b = shingles(line), shingles(edited)
                if len(a & b) >= 0.8 * len(a | b):
                    pairs.append((len(pairs), line, edited))
    # each pair alone, so that no third line links it
    keys = keys_of(spark, [t for p in pairs for t in p[1:]])
    missed = [i for i in range(len(pairs)) if not keys[2 * i] & keys[2 * i + 1]]
    assert len(pairs) > 1000
    assert len(missed) <= 0.01 * len(pairs), [pairs[i] for i in missed[:5]]
    sentence = "the members of the city council have agreed on a second hearing about the new bridge across the river before winter comes"
    out = lines.dedup_lines(spark.createDataFrame([(1, f"{sentence}\n{sentence} (2023-11-04)")], "doc_id bigint, text string"))
    assert [r["gone"] for r in out.collect()] == [[1]]


def test_rows_of_one_id_lose_their_own_lines(spark):
    rows = [(1, "a line that is in two documents"), (2, "A line that is in two documents\nits own end"), (2, "this has no copy anywhere\nnor has this one here"), (-(2**63), "x y z"), (2**63 - 1, "the last\nX Y Z")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([rows[0], (2, "its own end"), rows[2], rows[3], (2**63 - 1, "the last")])


def test_ids_of_any_type(spark):
    rows = [("b", "one line that is in both\nonly in b"), ("a", "one line that is in both\nonly in a"), (None, "one line that is in both")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {"a": rows[1][1], "b": "only in b", None: rows[2][1]}


def test_large_group_of_edited_copies(spark, sets):
    draw = random.Random(3)
    base = " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    rows = []
    for i in range(120):
        words = base.split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = "".join(draw.choice("klmnop") for _ in range(6))
        rows.append((i, " ".join(words)))
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows, sets)
    got = {(r["doc_id"], n) for r in out for n in r["gone"] or []}
    assert got <= want and len(got) >= 0.98 * len(want) > 50


def test_odd_documents(odd_docs, no_docs):
    out = lines.dedup_documents(odd_docs)
    assert out.columns == odd_docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert {1, 2, 3, 5, 6, None} <= set(kept)
    assert lines.dedup_documents(no_docs).count() == 0
