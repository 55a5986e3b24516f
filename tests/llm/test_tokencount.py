from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import queries, tokencount


def longest_match(word, first, rest):
    """Number of pieces by trying the longest one first; 0 if none fits."""
    at, n = 0, 0
    while at < len(word):
        known = rest if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=6), st.lists(st.text("ab", min_size=1, max_size=4), max_size=6), st.text("abc", min_size=1, max_size=12))
def test_automaton_equals_longest_match(first, rest, word):
    assert tokencount.PieceCounter(first, rest).length(word) == longest_match(word, set(first), set(rest))


def test_query_equals_brute_force(spark, sf_dir, docs):
    first, rest = map(set, tokencount.vocabulary_of_pieces(queries.piece_model()))
    for_word: dict[str, int] = {}
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = tokencount.WORDS.findall(r["text"] or "")
        for w in words:
            if w not in for_word:
                for_word[w] = longest_match(w, first, rest)
        want[r["doc_id"]] = (len(words), sum(for_word[w] or 1 for w in words), sum(not for_word[w] for w in words))
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in queries.op2_token_counts(spark, sf_dir).collect()} == want


def test_odd_documents(odd_docs, no_docs):
    out = tokencount.count_documents(odd_docs, queries.piece_model())
    assert out.columns == [*odd_docs.columns, "token_counts"]
    assert {tuple(r["token_counts"]) for r in out.collect() if r["doc_id"] in (1, 2, 3)} == {(0, 0, 0)}
    assert tokencount.count_documents(no_docs, queries.piece_model()).count() == 0
