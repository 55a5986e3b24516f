"""Word-piece lengths by a linear longest-match automaton.

Greedy longest-match-first word pieces, counted without building them.  The
vocabulary is a trie whose nodes have failure links: where no child fits, the
automaton pops a number of finished pieces known in advance and goes on from
the node that stands for what is left.  Each character is read once, however
often a naive matcher would go back.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: single punctuation marks or symbols, and runs without white space and those.
WORDS = regex.compile(r"[\p{P}$+<=>^`|~]|[^\p{White_Space}\p{P}$+<=>^`|~]+")
#: Words remembered by one Python worker, and the longest of them; only a speed and memory matter.
CACHE_WORDS = 400_000
LONG_WORD = 64


def vocabulary_of_pieces(path: str) -> tuple[list[str], list[str]]:
    """Word-piece vocabulary (word starts, continuations) read off a sentencepiece file.

    Pieces with one leading word mark start a word, pieces without continue one.
    """
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    first, rest = [], []
    for i in range(pieces.get_piece_size()):
        if pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i):
            continue
        piece = pieces.id_to_piece(i)
        if piece.startswith("▁"):
            first.append(piece[1:])
        else:
            rest.append(piece)
    return [p for p in first if p and "▁" not in p], [p for p in rest if "▁" not in p]


class PieceCounter:
    """Automaton over two tries: word starts (node 0) and continuations (node 1)."""

    def __init__(self, first: list[str], rest: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        parent: list[tuple[int, str] | None] = [None, None]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    to = self.next[node].get(c)
                    if to is None:
                        to = self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                        parent.append((node, c))
                    node = to
                if node > 1:
                    ends[node] = True
        size = len(self.next)
        #: where to go on when no child fits, -1 for nowhere; pieces popped on the way
        self.fail, self.pops = [-1] * size, [0] * size
        layer = [n for root in (0, 1) for n in self.next[root].values()]
        while layer:
            for node in layer:
                if ends[node]:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                above, c = parent[node]
                at, popped = self.fail[above], self.pops[above]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.next[at][c], popped
            layer = [n for node in layer for n in self.next[node].values()]
        self.known: dict[str, int] = {}

    def length(self, word: str) -> int:
        """Pieces of a non-empty word; 0 if it can't be split (it is one unknown token)."""
        node, n = 0, 0
        for c in word:
            while (to := self.next[node].get(c)) is None:
                n += self.pops[node]
                node = self.fail[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            n += self.pops[node]
            node = self.fail[node]
            if node < 0:
                return 0
        return n

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens (an unknown word is one) and unknown words of a text; null: none."""
        words = WORDS.findall(text or "")
        known, tokens, unknown = self.known, 0, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.length(w)
                if len(w) <= LONG_WORD:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    known[w] = n
            if n:
                tokens += n
            else:
                unknown += 1
        return len(words), tokens + unknown, unknown


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(*vocabulary_of_pieces(path))
    return _counters[path]


def token_counts(text: Column, path: str) -> Column:
    """Struct ``n_words``, ``n_tokens``, ``n_unknown`` of whole texts; null has zeros."""

    @F.arrow_udf("n_words bigint, n_tokens bigint, n_unknown bigint")
    def count(texts: pa.Array) -> pa.Array:
        it = counter(path)
        rows = [it.count(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["n_words", "n_tokens", "n_unknown"])

    return count(text)


def count_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct column ``token_counts``, which replaces one of that name.

    A null or empty text has zeros; a word of any length is one word, read once;
    rows are counted one by one, so repeated rows have equal counts; an empty
    table gives no rows.
    """
    return docs.withColumn("token_counts", token_counts(F.col(text), path))
