from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(queries.piece_model())


CASES = ["", " ", "   a  b ", "\n\t\r", "▁ ▁x", "ab" * 3000, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Ünïcödé ﬁ Ⅷ", "日本語テキスト", "🙂🙃👩‍👩‍👧", "\x00\x01", "<s></s><unk>", "<0x41>", "http://x.y/z?q=1&r=2", "​﻿"]


@pytest.mark.parametrize("text", CASES)
def test_fixed_texts(library, coder, text):
    ids = library.encode(text)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinorst ▁ \n", max_size=200)))
def test_any_text(library, coder, text):
    ids = library.encode(text)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids)


def test_query_equals_library(spark, sf_dir, docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert {r[0]: tuple(r)[1:] for r in queries.op8_sentencepiece(spark, sf_dir).collect()} == want


def test_columns_and_odd_documents(odd_docs, no_docs, library):
    out = pieces.encode_documents(odd_docs, queries.piece_model())
    assert out.columns == [*odd_docs.columns, "piece_ids"]
    assert all(list(r["piece_ids"]) == library.encode(r["text"] or "") for r in out.collect())
    back = out.select("text", pieces.decoded_text(out["piece_ids"], queries.piece_model()).alias("back")).collect()
    assert all(r["back"] == library.decode(library.encode(r["text"] or "")) for r in back)
    assert pieces.encode_documents(no_docs, queries.piece_model()).count() == 0


def test_few_remembered_words_give_the_same_ids():
    coder = pieces.PieceCoder(queries.piece_model())
    texts = [" ".join(f"word{i * j % 97} {i}x{j}" for j in range(60)) for i in range(20)]
    want = [coder.encode(t) for t in texts]
    assert len(coder.words) > 50
    few = pieces.PieceCoder(queries.piece_model())
    few.bound(50)
    assert [few.encode(t) for t in texts] == want
    assert len(few.words) <= 50 and len(few.older) <= 50 and len(few.fits) <= 101
