"""SentencePiece merge-type encoding and decoding, by backtracking.

The encoder gives the ids of the sentencepiece library for BPE models without
running its merge loop over the text.  A sequence of pieces is the merge
result exactly if each piece merges to itself and each adjacent pair does, so:

* an Aho-Corasick automaton over the pieces gives the longest piece that
  starts at each position;
* a piece may follow another one if re-merging the characters of both gives
  the two again (remembered per pair);
* where nothing fits, the search goes back one piece and takes the next
  shorter one; a bit for each position that failed keeps it linear.

No piece holds a word mark other than as its prefix, so merges never cross the
start of a word and words can be encoded one by one (checked on loading).
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words remembered by one Python worker, and the longest of them; only a speed and memory matter.
CACHE_WORDS = 160_000
#: Pairs of pieces of which a worker remembers whether they stay apart.
CACHE_PAIRS = 320_000
LONG_WORD = 64


class PieceCoder:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = schema.ModelProto.SentencePiece
        if model.trainer_spec.model_type != schema.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type (BPE) models with byte fallback are supported")
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.strings = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.kind = kind
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a word mark after other characters")
        whole = [p for p in self.score if len(p) == 1]
        #: the last merge of each longer piece: its two parts and its score
        self.last: dict[str, tuple[str, str, float]] = {}
        for p in sorted(self.score, key=len):
            if len(p) > 1 and len(two := self.merge(p, 2)) == 2 and self.score.get(two[0] + two[1]) is not None:
                whole.append(p)
                self.last[p] = (*two, self.score[p])
        #: pieces made by a merge that scores above one of its parts', or that hold such a piece
        self.odd: set[str] = set()
        for p, (left, right, score) in self.last.items():
            if any(x in self.odd or (x in self.last and self.last[x][2] < score) for x in (left, right)):
                self.odd.add(p)
        self.shorter: dict[str, str] = {}
        known = set(whole)
        for p in whole:
            if len(p) > 1:
                self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in known), p[0])
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            if len(p) > 1:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.own = {p: p for p in self.ids}
        #: each id as text
        self.said = list(map(str, range(len(self.strings))))
        #: what each id stands for in UTF-8: a byte piece is its byte, a control piece nothing
        self.bytes = [b"" if p.type == kind.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else " \u2047 ".encode() if p.type == kind.UNKNOWN else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        #: words seen lately and before that: a full cache becomes the older one
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.bound()

    def bound(self, words: int | None = None) -> None:
        """Remember up to ``words`` words (each of two times) and twice as many pairs; by default CACHE_WORDS and CACHE_PAIRS."""
        self.most_words = CACHE_WORDS if words is None else words
        self.most_pairs = CACHE_PAIRS if words is None else 2 * words

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """Merge the characters of a short string down to ``stop`` parts: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, first: str, second: str) -> bool:
        """Whether the two pieces stay as they are when their characters are merged anew.

        The merges are taken back, latest first, while the pair that meets at
        the border is watched: it must never have been the better merge.
        """
        pair = (first, second)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > self.most_pairs:
                self.fits.clear()
            if first in self.odd or second in self.odd:
                known = self.merge(first + second) == [first, second]
            else:
                known = self._unmerged(first, second)
            # with the model's own strings, not the slices of a word that the pair came as
            self.fits[self.own.get(first, first), self.own.get(second, second)] = known
        return known

    def _unmerged(self, left: str, right: str) -> bool:
        score, last = self.score, self.last
        if left + right in score:
            return False
        a, b = last.get(left), last.get(right)
        while a is not None or b is not None:
            if b is None or (a is not None and a[2] < b[2]):
                # the border pair stood to the right of this merge: it wins only by a better score
                limit, left = a[2], a[1]
                a = last.get(left)
                if score.get(left + right, limit) > limit:
                    return False
            else:
                # the border pair stood to the left: it wins by an equal score, too
                limit, right = b[2], b[0]
                b = last.get(right)
                if (met := score.get(left + right)) is not None and met >= limit:
                    return False
        return True

    def split(self, word: str) -> list[str]:
        """The pieces (and unknown single characters) of one stretch of normalised text."""
        size = len(word)
        longest = [1] * size
        for end, n in self.automaton.iter(word):  # by ascending end: the last one is the longest
            longest[end + 1 - n] = n
        failed: bytearray | None = None
        fits = self.fits
        out: list[str] = []
        at, piece, last = 0, word[: longest[0]], None
        while True:
            end = at + len(piece)
            if (failed is None or not failed[end >> 3] >> (end & 7) & 1) and (
                last is None or (known if (known := fits.get((last, piece))) is not None else self.follows(last, piece))
            ):
                out.append(piece)
                if end == size:
                    return out
                at, last = end, piece
                piece = word[at : at + longest[at]]
                continue
            while (shorter := self.shorter.get(piece)) is None:
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
            piece = shorter

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word."""
        made = self.older.get(word)
        if made is None:
            known, found = self.ids, []
            for p in self.split(word):
                if (i := known.get(p)) is not None:
                    found.append(i)
                else:  # an unknown character as byte pieces
                    found += [self.byte_id[b] for b in p.encode("utf-8")]
            made = tuple(found)
        if len(word) > LONG_WORD:
            return made
        if len(self.words) >= self.most_words:
            self.older, self.words = self.words, {}
        self.words[word] = made
        return made

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        seen, get = self.words, self.word
        out: list[int] = []
        for w in _WORD.findall(self.prefix + text.replace(" ", MARK)):
            out += seen.get(w) or get(w)
            seen = self.words
        return out

    def surface(self, ids) -> str:
        """The text of ids before the first mark is taken off."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if self.types[i] == self.kind.BYTE:
                raw.append(int(self.strings[i][3:5], 16))
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if self.types[i] == self.kind.UNKNOWN:
                out.append(" ⁇ ")
            elif self.types[i] == self.kind.NORMAL:
                out.append(self.strings[i].replace(MARK, " "))
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids) -> str:
        ids = list(ids)
        raw = b"".join([self.bytes[i] for i in ids])
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:  # bytes that belong to no character
            text = self.surface(ids)
        first = next((i for i in ids if self.types[i] != self.kind.CONTROL), None)
        marked = first is not None and self.types[first] == self.kind.NORMAL and self.strings[first].startswith(MARK)
        return text[1:] if self.prefix and marked else text


#: A word: its marks and what follows up to the next mark.
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _utf8(raw: bytearray) -> str:
    """Decode; each byte that belongs to no character becomes one replacement character."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            out.append(raw[i : i + n].decode("utf-8"))
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder for each model and Python worker."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def piece_ids(text: Column, path: str, words: int | None = None) -> Column:
    """Ids of a text as ``array<int>``; null is taken as the empty text.

    ``words`` bounds what a worker remembers, see :meth:`PieceCoder.bound`.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        it = coder(path)
        it.bound(words)
        flat, ends = array("i"), [0]
        for t in texts.to_pylist():
            flat.extend(it.encode(t or ""))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return encode(text)


def decoded_text(ids: Column, path: str) -> Column:
    """The text of an ``array<int>`` of ids; null gives null."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        it = coder(path)
        return pa.array([None if r is None else it.decode(r) for r in rows.to_pylist()], pa.string())

    return decode(ids)


def piece_digest(text: Column, path: str) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` without shipping the ids.

    Null and empty texts have no tokens and the digests of the empty string.
    The decoded text is :meth:`PieceCoder.decode` of the ids that were encoded.
    """

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        it = coder(path)
        it.bound()
        said = it.said
        n, ids, back = [], [], []
        for t in texts.to_pylist():
            found = it.encode(t or "")
            n.append(len(found))
            ids.append(hashlib.sha256(",".join([said[i] for i in found]).encode()).hexdigest())
            back.append(hashlib.sha256(it.decode(found).encode()).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return digest(text)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", words: int | None = None) -> DataFrame:
    """All columns of ``docs`` and the ids of its texts.

    A column already named ``ids`` is replaced.  Null texts are taken as empty
    and have an empty array; repeated rows and empty tables need no care.
    With ``words``, workers remember fewer words: the same ids, in less memory
    and more time.
    """
    return docs.withColumn(ids, piece_ids(F.col(text), path, words))
