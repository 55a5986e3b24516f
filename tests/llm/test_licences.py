from __future__ import annotations

import re
import textwrap

from quillspark.llm import licences, queries

MIT = "Copyright X.\n" + "\n".join(licences.SENTENCES[k] for k in ("MIT-grant", "MIT-notice", "MIT-warranty"))
KIND = "doc_id bigint, text string"


KNOWN = {" ".join(re.findall("[a-z0-9]+", v.lower())): k for k, v in licences.SENTENCES.items()}


def brute(text):
    """Known sentences in order, then the rules one by one on the list of them."""
    placed = {}
    text = re.sub(r"(?i)(spdx-license-identifier):[ \t]*", r"\1 ", text or "")
    text = re.sub(r"(?i)(^|\n)[ \t]*(dnl|rem)[ \t]+", r"\1", text)
    for i, segment in enumerate(re.split(r"(?<=[.!?;:])\s+", text)):
        cuts = [((i, 0, 0), segment)]
        for j, part in enumerate(re.split(r"(?:\r\n?|\n)(?:[ \t\f\v]|[*#/;>|-])*(?:\r\n?|\n)\s*", segment)):
            cuts.append(((i, j, 0), part))
            cuts += [((i, j, k), row) for k, row in enumerate(re.split(r"[\n\r]+", part))]
        for at, said in cuts:
            known = KNOWN.get(" ".join(re.findall("[a-z0-9]+", said.lower())))
            if known:
                placed[i, known] = min(at, placed.get((i, known), at))
    left = [k for _, k in sorted((at, k) for (_, k), at in placed.items())]
    n, names = len(left), set()
    for name, ids in licences.RULES:
        start = 0
        while start < len(left):
            at, taken = start, []
            for x in ids:
                while at < len(left) and left[at] != x:
                    at += 1
                taken.append(at)
                at += 1
            if taken[-1] >= len(left):
                break
            names.add(name)
            left = [x for k, x in enumerate(left) if k not in taken]
            start = taken[-1] + 1 - len(taken)
    return {(name, n) for name in names}


def test_query_equals_brute_force(spark, sf_dir, docs):
    want = {(r["doc_id"], *x) for r in docs.select("doc_id", "text").collect() for x in brute(r["text"])}
    assert {(r["doc_id"], r["licence"], r["n_sentences"]) for r in queries.op6_licences(spark, sf_dir).collect()} == want != set()


def test_first_rule_takes_its_sentences(spark):
    s = licences.SENTENCES
    two, three = ("BSD-grant", "BSD-source", "BSD-binary"), ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse")
    texts = ["\n".join(s[k] for k in ids) for ids in (three, two, three + three, three + two, two + three, ("BSD-grant", "BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-source", "BSD-binary"))]
    texts += [f"{texts[0]}\n\nunrelated words here.\n\n{MIT}", s["MIT-0-grant"] + " " + s["MIT-warranty"], s["0BSD-grant"] + " " + s["ISC-warranty"], s["ISC-grant"] + " " + s["ISC-warranty"]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, KIND)
    got = {(r["doc_id"], r["licence"], r["n_sentences"]) for r in licences.scan_licences(df).collect()}
    assert got == {(i, *x) for i, t in rows for x in brute(t)}
    assert {(i, x) for i, x, _ in got} == {(0, "BSD-3-Clause"), (1, "BSD-2-Clause"), (2, "BSD-3-Clause"), (3, "BSD-3-Clause"), (3, "BSD-2-Clause"), (4, "BSD-3-Clause"), (4, "BSD-2-Clause"), (5, "BSD-3-Clause"), (5, "BSD-2-Clause"), (6, "BSD-3-Clause"), (6, "MIT"), (7, "MIT-0"), (8, "0BSD"), (9, "ISC")}


def test_known_sentences_are_cut_as_texts_are():
    said = [licences.normal(v) for v in licences.SENTENCES.values()]
    assert len(set(said)) == len(said)
    assert all(len(re.split(r"(?<=[.!?;:])\s+", v)) == 1 for v in licences.SENTENCES.values())
    assert {i for _, ids in licences.RULES for i in ids} <= set(licences.SENTENCES)


def test_sql_equals_the_operator_on_standard_texts(spark):
    import duckdb

    s = licences.SENTENCES
    rows = [(i, "\n\n".join(textwrap.fill(s[x], 70) for x in ids) + f"\n{name}\n") for i, (name, ids) in enumerate(licences.RULES)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = {tuple(r) for r in con.execute(licences.scan_sql()).fetchall()}
    assert {(r["doc_id"], r["licence"], r["n_sentences"]) for r in licences.scan_licences(spark.createDataFrame(rows, KIND)).collect()} == want == {(i, *x) for i, t in rows for x in brute(t)}


def found(df):
    return {(r["doc_id"], r["licence"]) for r in licences.scan_licences(df).collect()}


def test_rules_need_their_order(spark):
    s = licences.SENTENCES
    rows = [(1, MIT), (2, s["MIT-warranty"] + " " + s["MIT-notice"] + " " + s["MIT-grant"]), (3, "Text. released under the mit   license! More."), (4, MIT.replace("deal in", "deal within")), (5, "Our license is kind."), (6, MIT.replace(" ", "\n"))]
    assert found(spark.createDataFrame(rows, KIND)) == {(1, "MIT"), (3, "MIT"), (6, "MIT")}


def test_each_rule_finds_itself(spark):
    rows = [(i, " ".join(licences.SENTENCES[x] for x in ids)) for i, (_, ids) in enumerate(licences.RULES)]
    assert {(i, name) for i, (name, _) in enumerate(licences.RULES)} <= found(spark.createDataFrame(rows, KIND))


def test_wrapped_notices_below_title_and_copyright(spark):
    s, rows, want = licences.SENTENCES, [], set()
    heads = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": "My project", "GPL-2.0-or-later": "My program", "GPL-3.0-or-later": "My program"}
    for name, ids in licences.RULES:
        if len(ids) > 1:
            for lead, width in (("", 72), ("# ", 60), (" * ", 76)):
                said = " ".join(s[i] for i in ids) if name[:3] in ("GPL", "Apa") else "\n\n".join(textwrap.fill(s[i], width) for i in ids)
                body = said if "\n" in said else textwrap.fill(said, width)
                notice = f"{heads.get(name, name)}\n\nCopyright (c) 2020 Jane Doe\n\n{body}\n"
                rows.append((len(rows), "\n".join((lead + x).rstrip() for x in notice.split("\n"))))
                want.add((len(rows) - 1, name))
    # the copyright line right above: one sentence is whole by lines, the others only across them
    rows.append((100, "Copyright (c) 2020 Jane Doe\n" + s["MIT-grant"] + "\n\n" + textwrap.fill(s["MIT-notice"], 72) + "\n\n" + textwrap.fill(s["MIT-warranty"], 72)))
    assert want | {(100, "MIT")} <= found(spark.createDataFrame(rows, KIND))


def test_tags_and_short_notices(spark):
    s = licences.SENTENCES
    gpl = textwrap.fill(s["GPL-free"] + " " + s["GPL-v3"], 70)
    texts = {
        "// SPDX-License-Identifier: Apache-2.0\nint x;": "Apache-2.0",
        "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n": "GPL-2.0-only WITH Classpath-exception-2.0",
        "/* SPDX-License-Identifier:GPL-2.0+ */": "GPL-2.0",
        "/* spdx-license-identifier: (GPL-2.0-only OR BSD-2-Clause) */": "GPL-2.0-only OR BSD-2-Clause",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0 OR MIT",
        "Words.\n\nThis file is licensed under MIT.": "MIT",
        f"Name\n\n{gpl}\n": "GPL-3.0-or-later",
        "\n".join("dnl " + x for x in gpl.split("\n")): "GPL-3.0-or-later",
    }
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, KIND)) == {(i, texts[t]) for i, t in rows}
    assert found(spark.createDataFrame([(1, "mit Apache-2.0 und SPDX-License-Identifier"), (2, "SPDX-License-Identifier: Mine")], KIND)) == set()


def test_cues_cover_every_sentence():
    words = licences.cues(licences.SENTENCES)
    assert all(any(w in licences.normal(s).split() for w in words) for s in licences.SENTENCES.values())


def test_odd_documents(spark, odd_docs, no_docs):
    assert found(odd_docs) == set() == found(no_docs)
    twice = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Licensed under CC BY 4.0."), (None, MIT)], KIND)
    assert found(twice) == {(1, "MIT"), (1, "CC-BY-4.0"), (None, "MIT")}
