from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat, queries

KIND = "tree bigint, msg bigint, parent bigint, role string, text string, score double"
SAYS = r"\### Assistant: </turn> ok"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_query_equals_brute_force(spark, sf_dir):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        talks[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    talks[-7] = [(0, "user", SAYS), (1, "assistant", SAYS)]
    want = {}
    for c, turns in talks.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        want[c] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(learned), sha(learned))
    out = queries.op9_chat_format(spark, sf_dir).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out} == want
    assert all(r["formatted_chars"] > r["loss_chars"] for r in out)


def test_branches_are_ranked_by_score(spark):
    #     1 -> 2 (0.5) -> 4 (0.1);  1 -> 3 (0.2) -> 5 (0.9);  and a lone root 6
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 1, "assistant", "b", 0.2), (1, 4, 2, "user", "c", 0.1), (1, 5, 3, "user", "d", 0.9), (1, 6, None, "user", "e", None), (2, 1, 99, "user", "lost", 1.0)]
    out = chat.format_branches(spark.createDataFrame(rows, KIND), best=2)
    said = {(r["tree"], r["rank"]): [t for _, t in chat.read_back(r["formatted"])] for r in out.collect()}
    assert said == {(1, 1): ["q", "b", "d"], (1, 2): ["q", "a", "c"], (2, 1): ["lost"]}


def test_deep_tree_and_cycle(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)]
    (row,) = chat.format_branches(spark.createDataFrame(rows, KIND)).collect()
    assert [t for _, t in chat.read_back(row["formatted"])] == [str(i) for i in range(70)]
    with pytest.raises(ValueError, match="cycle"):
        chat.branches(spark.createDataFrame([(1, 1, 2, "user", "", 0.0), (1, 2, 1, "user", "", 0.0)], KIND), max_rounds=6)


TEXTS = st.lists(st.sampled_from([*"<>/\\turn \n", "<turn>", "</turn>", "<\\turn>", "</turn>\n"]), max_size=12).map("".join)
TALKS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "<turn>", "a b\n%", ""]), TEXTS), min_size=1, max_size=4)


@settings(max_examples=3, deadline=None)
@given(st.lists(TALKS, min_size=30, max_size=60))
def test_round_trip_of_any_text(spark, talks):
    rows = [(k, i, i - 1 if i else None, role, text, 0.0) for k, turns in enumerate(talks) for i, (role, text) in enumerate(turns)]
    out = {r["tree"]: r for r in chat.format_branches(spark.createDataFrame(rows, KIND)).collect()}
    for k, turns in enumerate(talks):
        text = out[k]["formatted"]
        assert chat.read_back(text) == turns
        learned = [chat.unescape_text(text[s["start"] : s["start"] + s["length"]]) for s in out[k]["loss"]]
        assert learned == [t for role, t in turns if role == "assistant"]


def test_nulls_and_empty(spark):
    turns = spark.createDataFrame([(None, 1, None, None), (None, None, "assistant", "x"), (3, 1, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_branches(chat.conversation_messages(turns))
    assert {r["tree"]: chat.read_back(r["formatted"]) for r in out.collect()} == {None: [("assistant", "x"), ("", "")], 3: [("user", "")]}
    assert chat.format_branches(chat.conversation_messages(turns.limit(0))).count() == 0
