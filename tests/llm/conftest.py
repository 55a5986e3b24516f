from __future__ import annotations

import pytest

ODD = [(1, None, None, None), (2, "", "en", "s0"), (3, "   \n\t ", None, "s1"), (4, "a b c d e f", "en", "s0"), (4, "a b c d e f", "en", "s0"), (None, "a b c d e f", "en", "s0"), (5, "123 456 !!", "de", None), (6, "lang wort " * 30_000, "de", "s1")]


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, blank and very long texts, repeated rows, columns with clashing names."""
    rows = [(*r, "x", "y", "z", 7) for r in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, key string, h string, language string, n_tokens int")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Sets:
    """Union-find by brute force."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture
def sets():
    return Sets()
