"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character n-grams.  A document is
a mixture of languages: expectation-maximisation estimates the proportions
from the n-gram likelihoods, and the set of languages is the one with the best
penalised likelihood among the k strongest, k = 1, 2, ...
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
BUCKETS = 1 << 16
#: The classifier is fitted on about this many labelled rows of a language at most.
SAMPLE_PER_LANGUAGE = 4000
#: Learned languages; a table with more labels than this is refused, not cut.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_SALT = 8191

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngram_buckets(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased letters of a whole text; other characters are one gap.

    No letter: empty.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, dtype=np.uint32)
    points = np.where(letter, points, 0)
    gap = points == 0
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    points = np.concatenate([[0], points[keep], [0]]).astype(np.uint32)
    if len(points) > 2 and points[1] == 0:
        points = points[1:]
    if points[-2] == 0:
        points = points[:-1]
    h = np.zeros(len(points) - ORDER + 1, dtype=np.uint32)
    for i in range(ORDER):
        h = (h * np.uint32(0x9E3779B1)) ^ points[i : len(points) - ORDER + 1 + i]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return (h >> np.uint32(16)) & np.uint32(BUCKETS - 1)


@dataclass
class LanguageModel:
    """Learned languages and their n-gram probabilities, one row a language."""

    languages: list[str]
    probabilities: np.ndarray

    def predict(self, text: str | None, rounds: int = 15) -> tuple[str, float, list[tuple[str, float]]]:
        """Strongest language, its share, and the shares of all languages of the set."""
        if text is None or not self.languages:
            return UNKNOWN, 0.0, []
        buckets = ngram_buckets(text)
        if not len(buckets):
            return UNKNOWN, 0.0, []
        found, counts = np.unique(buckets, return_counts=True)
        like = self.probabilities[:, found]
        shares = _mixture(like, counts, np.full(len(like), 1 / len(like)), rounds)
        order = np.argsort(-shares, kind="stable")
        total, best = counts.sum(), None
        for k in range(1, len(order) + 1):
            chosen = order[:k]
            start = shares[chosen]
            part = _mixture(like[chosen], counts, start / start.sum(), rounds) if k > 1 else np.ones(1)
            cost = -float(counts @ np.log(part @ like[chosen])) + (k - 1) * 0.5 * math.log(total + 1)
            if best is not None and cost >= best[0]:
                break
            best = (cost, chosen, part)
        _, chosen, part = best
        top = sorted(zip(part.tolist(), chosen.tolist()), key=lambda x: (-x[0], self.languages[x[1]]))
        named = [(self.languages[i], min(1.0, max(0.0, p))) for p, i in top]
        return named[0][0], named[0][1], named


def _mixture(like: np.ndarray, counts: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
    total = counts.sum()
    for _ in range(rounds):
        ratio = counts / np.maximum(shares @ like, 1e-300)
        new = shares * (like @ ratio) / total
        new = np.maximum(new, 1e-12)
        new /= new.sum()
        if np.abs(new - shares).max() < 1e-3:
            return new
        shares = new
    return shares


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``labelled`` whose text and language are not null.

    About ``sample`` rows of each language are used, chosen by a hash of
    ``key``, so the fit costs the same at every size; no other limit holds.
    What reaches the driver is one count per language and bucket.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in sizes)
    place = {x: i for i, x in enumerate(languages)}
    rates = rows.sparkSession.createDataFrame([(r["lang"], place[r["lang"]], min(1.0, sample / r["count"])) for r in sizes], "lang string, place int, rate double")
    position = F.pmod(F.xxhash64("key", F.lit(_SALT)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    chosen = rows.join(F.broadcast(rates), "lang").where(position < F.col("rate")).select("text", "place")
    n = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, BUCKETS), dtype=np.int64)
        for batch in batches:
            for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[p] += np.bincount(ngram_buckets(t), minlength=BUCKETS)
        place, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[place, bucket])], names=["place", "bucket", "n"])

    table = np.zeros((n, BUCKETS))
    if n:
        summed = chosen.mapInArrow(count, "place int, bucket int, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow()
        table[summed["place"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    table += 0.1
    return LanguageModel(languages, table / table.sum(axis=1, keepdims=True) if n else table)


def language_of(docs: DataFrame, name: str, text: str, model: LanguageModel) -> DataFrame:
    """``docs`` with a struct column ``name``: ``lang_pred``, ``score``, ``languages`` (array of lang, share) of whole texts.

    The model reaches each executor once, as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    def predict(texts: pa.Array) -> pa.Array:
        known = shared.value
        found = [known.predict(t) for t in texts.to_pylist()]
        shares = [[{"lang": x, "share": s} for x, s in f[2]] for f in found]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(shares, kind)],
            names=["lang_pred", "score", "languages"],
        )

    # so declared, it is run once a row, however many later columns and filters use it
    return docs.withColumn(name, predict.asNondeterministic()(F.col(text)))


def held_out(id: Column) -> Column:
    """Whether a row is kept out of learning."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with a struct column ``language``, which replaces one of that name.

    The model learns from the rows that are not held out.  Texts that are null
    or have no letter get ``und`` with score 0, as do all rows if there is
    nothing to learn from.  Of equally likely languages the one first by name
    wins; equal texts have equal results, however often they come; texts of
    any length are read whole; an empty table gives no rows.
    """
    model = fit(docs.where(~held_out(F.col(key))), text, lang, key)
    return language_of(docs, "language", text, model)


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that have no recognised language; columns unchanged.

    A null ``lang`` becomes the predicted language; a given one stays.  Rows
    go whose text is null or has no letter, and all if nothing could be learned.
    """
    name = "language" if "language" not in docs.columns else "language_" + "_".join(docs.columns)
    model = fit(docs.where(~held_out(F.col(key))), text, lang, key)
    found = language_of(docs, name, text, model).where(F.col(f"`{name}`.lang_pred") != UNKNOWN)
    columns = [F.coalesce(F.col(f"`{c}`"), F.col(f"`{name}`.lang_pred")).alias(c) if c == lang else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns)
