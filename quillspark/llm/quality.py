"""Quality classifier: Bradley-Terry ranking of documents, cut at a quantile of the scores.

A document is a vector of bounded features of its whole text.  Every pair of a
good and a bad labelled document is a preference, and the
probability that the good one is preferred is the logistic function of the
difference of their scores: a logistic loss on feature differences, which has
no intercept and so no notion of a threshold.  That is drawn afterwards, at a
quantile of the scores of the labelled rows.

All labelled rows take part, and all their pairs, without listing them: what a
row gives to the sums over pairs depends on its score alone, smoothly.  So rows
are dealt to the nodes of a grid of scores around theirs, by the weights of
polynomial interpolation, and the nodes are paired.  Spark sums up nodes and
slopes over blocks of rows, twice a round; the work grows with the rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import cut

#: Weight of the penalty on squared coefficients, a pair being one.
PENALTY = 1e-3
ROUNDS = 30
#: Score of a document right at the cutoff.
CUTOFF = 0.3
#: Knots of each feature, as quantiles of the labelled rows, and the ends of its range.
_KNOTS = (0.1, 0.3, 0.5, 0.7, 0.9)
_ENDS = (0.005, 0.995)
#: Width of the grid of scores, and nodes a row is dealt to: sums over pairs are right to about 1e-11 of their number.
_WIDTH, _NODES = 0.125, 10
#: Entries of a block of rows by nodes at once.
_BLOCK = 1_000_000
#: Bins that quantiles are narrowed by.
_BINS = 1024

FEATURES = [
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "caps_words", "plain_words", "marked_words", "bare_words",
    "same_as_before", "top_word", "distinct_pairs", "repeated_lines", "log_line", "letters",
]
_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _SYMBOL = range(6)
_MARKS = set(".,;:'\"?()-–—«»¿¡’“”…")

_classes: np.ndarray | None = None


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))
    if kind in ("Lu", "Lt"):
        return _UPPER
    if kind[0] in "LM":
        return _LOWER
    if kind[0] == "N":
        return _DIGIT
    if kind[0] == "Z" or 9 <= c <= 13:
        return _SPACE
    return _MARK if chr(c) in _MARKS else _SYMBOL


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        _classes = np.fromiter(map(_class, range(0x110000)), dtype=np.uint8, count=0x110000)
    return _classes


def features(text: str | None) -> list[float]:
    """:data:`FEATURES` of a whole text; of a null, empty or blank one all are 0."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _class_table()[points]
    count = np.bincount(kinds, minlength=6)
    chars, letters = len(points) - count[_SPACE], count[_UPPER] + count[_LOWER]
    # words as runs of other characters than spaces: kinds within a word by cumulated counts
    filled = np.concatenate([[False], kinds != _SPACE, [False]])
    starts, ends = np.flatnonzero(~filled[:-1] & filled[1:]), np.flatnonzero(filled[:-1] & ~filled[1:])
    within = lambda kind: np.add.reduceat((kinds == kind).astype(np.int32), starts) if len(starts) else np.zeros(0)
    size = ends - starts
    # a run from its start to the next word holds spaces besides, which are of none of the kinds asked for
    upper, lower, odd = within(_UPPER), within(_LOWER), within(_SYMBOL)
    caps, bare = (upper > 1) & (lower == 0), upper + lower == 0
    again = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    runs = len(size)
    return [
        math.log1p(n),
        min(30.0, chars / n),
        float(count[_UPPER] / max(1, letters)),
        float(count[_DIGIT] / max(1, chars)),
        float(count[_MARK] / max(1, chars)),
        float(count[_SYMBOL] / max(1, chars)),
        float(caps.sum() / max(1, runs)),
        float(((upper == 0) & (lower == size)).sum() / max(1, runs)),
        float((odd > 0).sum() / max(1, runs)),
        float(bare.sum() / max(1, runs)),
        again / n,
        Counter(words).most_common(1)[0][1] / n,
        pairs / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(len(text) / max(1, len(lines))),
        float(letters / max(1, chars)),
    ]


def features_of(text: Column) -> Column:
    """:func:`features` as an array of doubles."""

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return measured(text)


@dataclass
class Ranking:
    """Learned scores: piecewise linear in each feature, cut at ``cutoff``."""

    low: np.ndarray
    span: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cutoff: float = 0.0
    unit: float = 1.0

    def expand(self, rows: np.ndarray) -> np.ndarray:
        """Features within their range, with what exceeds each knot."""
        x = np.clip((rows - self.low) / self.span, -0.5, 1.5)
        return np.concatenate([x, np.maximum(0, x[:, :, None] - self.knots[None]).reshape(len(x), -1)], axis=1)

    def strength(self, rows: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores on the scale of log odds between two documents."""
        return self.expand(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1, :data:`CUTOFF` right at the cutoff."""
        z = (self.strength(rows) - self.cutoff) / self.unit + math.log(CUTOFF / (1 - CUTOFF))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _unfitted(low: np.ndarray, high: np.ndarray, knots: np.ndarray) -> Ranking:
    """``knots``: an array of features by knots, on the features' own scale."""
    span = np.where(high > low, high - low, 1.0)
    return Ranking(low, span, np.clip((knots - low[:, None]) / span[:, None], 0, 1), np.zeros(len(low) * (1 + len(_KNOTS))))


def _dealt(strengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First node of each row, and the weights of that and the next nodes (Lagrange's)."""
    x = strengths / _WIDTH
    first = np.floor(x).astype(np.int64) - (_NODES // 2 - 1)
    off = (x - first)[:, None] - np.arange(_NODES)
    parts = np.ones((len(x), _NODES))
    for k in range(_NODES):
        for m in range(_NODES):
            if m != k:
                parts[:, k] *= off[:, m] / (k - m)
    return first, parts


def _masses(strengths: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows on the grid: the first node, and the sum of weights at each from there on."""
    first, parts = _dealt(strengths)
    low = int(first.min())
    return low, np.bincount(((first - low)[:, None] + np.arange(_NODES)).ravel(), parts.ravel())


def _joined(found: Iterable[tuple[int, int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Sums of (kind, first node, masses) as one array of both kinds by nodes, with the first node."""
    found = list(found)
    # a node more on either side, as a score may be rounded otherwise when it is worked out again
    low = min(at for _, at, _ in found) - 1
    total = np.zeros((2, max(at + len(mass) for _, at, mass in found) + 1 - low))
    for kind, at, mass in found:
        total[kind, at - low : at - low + len(mass)] += mass
    return low, total


def _sums_of(ranking: Ranking, low: int, pull: np.ndarray, bend: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flat sums over rows: slope, curvature of the rows, and features dealt to the nodes for either kind."""
    wide, nodes = len(ranking.weights), pull.shape[1]
    slope, curve, placed = np.zeros(wide), np.zeros((wide, wide)), np.zeros((2, nodes, wide))
    size = max(1, _BLOCK // nodes)
    for of, sign in ((0, 1.0), (1, -1.0)):
        mine = rows[kind == of]
        for at in range(0, len(mine), size):
            x = ranking.expand(mine[at : at + size])
            first, parts = _dealt(x @ ranking.weights)
            dealt = np.zeros((len(x), nodes))
            dealt[np.arange(len(x))[:, None], (first - low)[:, None] + np.arange(_NODES)] = parts
            slope += sign * (x.T @ (dealt @ pull[of]))
            curve += x.T @ (x * (dealt @ bend[of])[:, None])
            placed[of] += dealt.T @ x
    return np.concatenate([slope, curve.ravel(), placed.ravel()])


def _descend(
    ranking: Ranking,
    pairs: float,
    masses: Callable[[Ranking], Iterable[tuple[int, int, np.ndarray]]],
    sums: Callable[[Ranking, int, np.ndarray, np.ndarray], np.ndarray],
    penalty: float,
    rounds: int,
) -> Ranking:
    """Newton's method on the mean loss of all pairs.

    ``masses`` gives what :func:`_masses` says of blocks of rows, with the
    kind, and ``sums`` the sum of :func:`_sums_of` over all rows.
    """
    wide = len(ranking.weights)

    def looked_at(w: np.ndarray) -> tuple[float, int, np.ndarray]:
        low, mass = _joined(masses(replace(ranking, weights=w)))
        apart = _WIDTH * np.arange(1 - mass.shape[1], mass.shape[1])
        return float(mass[0] @ np.convolve(np.logaddexp(0, apart), mass[1], "valid") / pairs + penalty * w @ w), low, mass

    w = ranking.weights
    now, low, mass = looked_at(w)
    for _ in range(rounds):
        apart = _WIDTH * np.arange(1 - mass.shape[1], mass.shape[1])
        p = 1 / (1 + np.exp(-np.clip(apart, -700, 700)))
        q = p * (1 - p)
        # of a node of one kind, summed over the nodes of the other
        pull = np.stack([np.convolve(p, mass[1], "valid"), np.convolve(p[::-1], mass[0], "valid")])
        bend = np.stack([np.convolve(q, mass[1], "valid"), np.convolve(q, mass[0], "valid")])
        slope, curve, placed = np.split(sums(replace(ranking, weights=w), low, pull, bend), [wide, wide + wide * wide])
        placed = placed.reshape(2, -1, wide)
        near = np.stack([np.convolve(q, column, "valid") for column in placed[0].T], axis=1)
        mixed = placed[1].T @ near
        curve = (curve.reshape(wide, wide) - mixed - mixed.T) / pairs + 2 * penalty * np.eye(wide)
        step, size = np.linalg.solve(curve, slope / pairs + 2 * penalty * w), 1.0
        # weights whose penalty alone exceeds the loss are no improvement
        while penalty * np.sum((w - size * step) ** 2) > now and size > 1e-4:
            size /= 2
        while (then := looked_at(w - size * step))[0] > now and size > 1e-4:
            size /= 2
        if then[0] >= now - 1e-10:
            break
        w, (now, low, mass) = w - size * step, then
    return replace(ranking, weights=w)


def rank_pairs(good: np.ndarray, bad: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> Ranking:
    """Fit on all pairs of a good and a bad row that are at hand; :func:`fit` does so for those of a table."""
    every, kind = np.concatenate([good, bad]), np.repeat([1, 0], [len(good), len(bad)])
    low, high = np.quantile(every, _ENDS, axis=0)
    start = _unfitted(low, high, np.quantile(every, _KNOTS, axis=0).T)
    masses = lambda r: [(k, *_masses(r.strength(rows))) for k, rows in ((0, bad), (1, good))]
    return _descend(start, len(good) * len(bad), masses, lambda r, *grid: _sums_of(r, *grid, kind, every), penalty, rounds)


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    kind = batch.column("label").to_numpy(zero_copy_only=False)
    return kind, batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(kind), -1)


def _rank_rows(rows: DataFrame, start: Ranking, pairs: float) -> Ranking:
    """:func:`_descend` on all ``rows`` (``label``, ``features``): each task sums up its rows."""

    def masses(ranking: Ranking) -> Iterable[tuple[int, int, np.ndarray]]:
        def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for kind, x in map(_rows_of, batches):
                for at in range(0, len(x), _BLOCK // 100):
                    strengths, of = ranking.strength(x[at : at + _BLOCK // 100]), kind[at : at + _BLOCK // 100]
                    found += [(k, *_masses(strengths[of == k])) for k in (0, 1) if (of == k).any()]
                    low, total = _joined(found)
                    found = [(k, low + 1, total[k, 1:-1]) for k in (0, 1)]
            if found:
                yield pa.RecordBatch.from_pydict({"kind": pa.array([f[0] for f in found], pa.int32()), "low": pa.array([f[1] for f in found], pa.int64()), "mass": pa.array([f[2] for f in found], pa.list_(pa.float64()))})

        for r in rows.mapInArrow(laid, "kind int, low bigint, mass array<double>").toArrow().to_pylist():
            yield r["kind"], r["low"], np.array(r["mass"])

    def sums(ranking: Ranking, low: int, pull: np.ndarray, bend: np.ndarray) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for kind, x in map(_rows_of, batches):
                own = _sums_of(ranking, low, pull, bend, kind, x)
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

        found = rows.mapInArrow(summed, "sums array<double>").toArrow().column("sums")
        return sum(x.values.to_numpy() for x in found)

    return _descend(start, pairs, masses, sums, PENALTY, ROUNDS)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle between the two neighbouring values that the quantile falls between, of values at hand; :func:`quantiles` finds those of a table."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order]) / weights.sum()
    # a share that is met up to rounding lies between two values
    at = int(np.searchsorted(upto, share - 1e-9))
    return float((values[order[min(at, len(order) - 1)]] + values[order[min(at + 1, len(order) - 1)]]) / 2)


def quantiles(values: DataFrame, shares: dict[int, list[float]]) -> dict[tuple[int, float], tuple[float, float]]:
    """For each group ``of`` and share the value at that quantile and the next greater one (itself if there is none), exactly.

    ``values`` has ``of``, ``value`` and ``weight``.  A group's range is cut
    into bins, of which only those that hold a quantile are cut further, until
    each holds one value: the driver gets sums by bin.
    """
    ends = values.groupBy("of").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("weight").alias("total")).collect()
    totals = {r["of"]: r["total"] for r in ends}
    # the span that holds a quantile, the weight below it, and the next value beyond
    left = {(r["of"], share): (r["lo"], r["hi"], 0.0, r["hi"]) for r in ends for share in shares[r["of"]]}
    found = {}
    while left:
        spans = values.sparkSession.createDataFrame(sorted({(of, *span[:2]) for (of, _), span in left.items()}), "of int, lo double, hi double")
        inside = values.join(F.broadcast(spans), "of").where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        step = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _BINS)
        bin = F.when(F.col("hi") > F.col("lo"), F.least(step, F.lit(_BINS - 1))).otherwise(0)
        bins = inside.groupBy("of", "lo", "hi", bin.alias("bin")).agg(F.min("value").alias("first"), F.max("value").alias("last"), F.sum("weight").alias("weight"))
        held: dict[tuple, list] = {}
        for r in sorted(bins.collect(), key=lambda r: (r["of"], r["lo"], r["bin"])):
            held.setdefault((r["of"], r["lo"], r["hi"]), []).append((r["first"], r["last"], r["weight"]))
        for (of, share), (lo, hi, below, beyond) in list(left.items()):
            row = held[of, lo, hi]
            upto = below + np.cumsum([weight for *_, weight in row])
            # a share that is met up to rounding lies between two values
            at = min(int(np.searchsorted(upto, (share - 1e-9) * totals[of])), len(row) - 1)
            first, last, weight = row[at]
            beyond = row[at + 1][0] if at + 1 < len(row) else beyond
            if first < last:
                left[of, share] = (first, last, float(upto[at]) - weight, beyond)
            else:
                found[of, share] = (first, beyond)
                del left[of, share]
    return found


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``label`` (1 or 0), ``times`` (how often it comes) and ``features`` of all documents that ``labels`` marks.

    Features are few bytes, so they are taken before the join and no text is shuffled.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    counted = marked.groupBy("label", "key").agg(F.count("*").alias("times"))
    measured = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), features_of(F.col(text)).alias("features"))
    return measured.join(counted, "key").select("label", "times", "features")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", share: float | None = None) -> Ranking | None:
    """Learn from all documents that ``labels`` marks 1 (good) or 0 (bad).

    What reaches the driver are sums over rows.  ``share`` is the quantile of
    the labelled rows' scores that is the cutoff; by default the share of bad
    ones.  ``None`` if there are no labelled documents of both kinds.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    rows = cut(labelled(docs, labels, text, key, label))
    taken = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("times").alias("times")).collect()}
    if len(taken) < 2:
        return None
    values = rows.select(F.posexplode("features").alias("of", "value"), F.lit(1.0).alias("weight"))
    at = quantiles(values, {f: [*_ENDS, *_KNOTS] for f in range(len(FEATURES))})
    low, high, *knots = (np.array([at[f, share][0] for f in range(len(FEATURES))]) for share in (*_ENDS, *_KNOTS))
    found = _rank_rows(rows, _unfitted(low, high, np.stack(knots, axis=1)), taken[0]["n"] * taken[1]["n"])

    @F.arrow_udf("double")
    def strength(measured: pa.Array) -> pa.Array:
        return pa.array(found.strength(measured.flatten().to_numpy(zero_copy_only=False).reshape(len(measured), -1)), pa.float64())

    weight = F.col("times") * F.when(F.col("label") == 1, sizes[1] / taken[1]["times"]).otherwise(sizes[0] / taken[0]["times"])
    scored = cut(rows.select("label", strength(F.col("features")).alias("value"), weight.alias("weight")))
    kinds = scored.select((F.col("label") + 1).alias("of"), "value", F.lit(1.0).alias("weight"))
    share = sizes[0] / (sizes[0] + sizes[1]) if share is None else share
    at = quantiles(scored.select(F.lit(0).alias("of"), "value", "weight").unionByName(kinds), {0: [share], 1: [0.5], 2: [0.5]})
    found.cutoff = (at[0, share][0] + at[0, share][1]) / 2
    # half the way between the kinds' middles is two log odds
    found.unit = max(1e-9, (at[2, 0.5][0] - at[1, 0.5][0]) / 8)
    return found


def score_of(docs: DataFrame, name: str, text: str, ranking: Ranking | None) -> DataFrame:
    """``docs`` with a double column ``name``, 0 to 1; without a ranking all are at the cutoff."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if shared.value is None or not len(texts):
            return pa.array([CUTOFF] * len(texts), pa.float64())
        return pa.array(shared.value.score(np.array([features(t) for t in texts.to_pylist()])), pa.float64())

    # so declared, it is run once a row, however many later columns and filters use it
    return docs.withColumn(name, scored.asNondeterministic()(F.col(text)))


def held_out(id: Column) -> Column:
    """Whether a row is kept out of learning."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(5)) == 0, F.lit(False))


def rate_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """All columns of ``docs`` with a column ``quality_score``, which replaces one of that name.

    Learns from the labelled rows that are not held out; other columns than
    the text take no part in a score.  Null, empty and blank texts have the
    same score; equal texts have equal scores; texts of any length are read
    whole; labels other than 0 and 1, null keys and keys without a document
    are not learned from; a key with both labels is learned from as both;
    repeated labels count as often as they come for the quantile.  With nothing to learn from all scores
    are the cutoff.  An empty table gives no rows.
    """
    ranking = fit(docs.where(~held_out(F.col(key))), labels.where(~held_out(F.col(key))), text, key, label)
    return score_of(docs, "quality_score", text, ranking)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``docs`` without those that score below the cutoff; columns unchanged."""
    name = "quality_score" if "quality_score" not in docs.columns else "quality_" + "_".join(docs.columns)
    ranking = fit(docs.where(~held_out(F.col(key))), labels.where(~held_out(F.col(key))), text, key, label)
    return score_of(docs, name, text, ranking).where(F.col(f"`{name}`") >= CUTOFF).select(*[F.col(f"`{c}`") for c in docs.columns])
