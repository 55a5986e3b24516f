"""Embedding whitening by merging singular value decompositions.

Entries become whole numbers, so sums, means and deviations are exact.  Each
partition of the distinct vectors is reduced, batch after batch, to its number
of rows, sums, and the singular values and right vectors of its centred rows,
all of them.  Two such summaries merge into one: their scaled vectors and one
row for the difference of their means, sqrt(n m / (n + m)) (mean - mean'),
have together the scatter of both, and are decomposed again.  Merges go up a
tree; a summary never has more than the square of the dimension, and nothing
of the spectrum is lost on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import cut, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Summaries merged in one group.
FAN_IN = 16
#: Entries from this size on have no exact whole number as a double.
_GREATEST = float(2**52 // SCALE)
#: Singular values up to this share of the greatest are rounding of zero.
_ZERO = 1e-11
_SUMMARY = "pid int, n bigint, dims int, sums array<decimal(38,0)>, scaled array<double>"


def whole(embedding: Column) -> Column:
    """Entries as whole numbers; null for a vector that is null or empty, or holds an entry that is null, not finite or from 2^46 on."""
    exact = F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(_GREATEST), F.lit(False)))
    made = F.transform(embedding, lambda c: (F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(OFFSET)).cast("bigint"))
    return F.when((F.size(embedding) > 0) & exact, made)


@dataclass
class Summary:
    """Rows, sums, and R with R'R the scatter of the rows around their mean."""

    n: int
    sums: list[int]
    scaled: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Summary:
        n, sums = len(rows), [int(s) for s in rows.sum(axis=0, dtype=object if np.abs(rows).max() > 2**40 else np.int64)]
        return Summary(n, sums, _reduced(centred(rows, n, sums)))

    def merge(self, other: Summary) -> Summary:
        n, m = self.n, other.n
        # the difference of the means from whole numbers, so that nothing cancels
        apart = np.array([a * m - b * n for a, b in zip(self.sums, other.sums)], dtype=object) / (n * m)
        row = (n * m / (n + m)) ** 0.5 * apart.astype(np.float64)
        return Summary(n + m, [a + b for a, b in zip(self.sums, other.sums)], _reduced(np.vstack([self.scaled, other.scaled, row])))


def _reduced(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: at most as many rows as dimensions."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where they surely fit, else as Python's whole numbers."""
    greatest = max([int(np.abs(rows).max()) * n if len(rows) else 0, *map(abs, sums)])
    if greatest < 2**61:
        return rows * n - np.array(sums, dtype=np.int64)
    return rows.astype(object) * n - np.array(sums, dtype=object)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (deviations(rows, n, sums) / n).astype(np.float64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _row(pid: int, found: Summary) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64())]
    values = [pid, found.n, len(found.sums), found.sums, found.scaled.ravel()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["pid", "n", "dims", "sums", "scaled"])


def _summarised(vectors: DataFrame, dims: int) -> DataFrame:
    """One summary for each partition of ``x``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pid = None, 0
        for batch in batches:
            if batch.num_rows:
                part, pid = Summary.of(_matrix(batch.column(0), dims)), batch.column(1)[0].as_py()
                found = part if found is None else found.merge(part)
        if found is not None:
            yield _row(pid, found)

    return vectors.select("x", F.spark_partition_id().alias("pid")).mapInArrow(work, _SUMMARY)


def _merged(group: pa.Table) -> pa.Table:
    """The summaries of one group, at most :data:`FAN_IN`, as one."""
    found = None
    for row in group.sort_by("pid").to_pylist():
        one = Summary(row["n"], [int(s) for s in row["sums"]], np.array(row["scaled"]).reshape(-1, row["dims"]))
        found = one if found is None else found.merge(one)
    return pa.Table.from_batches([_row(group["up"][0].as_py(), found)])


@dataclass
class Whitening:
    """What was fitted: exact number and sums of vectors, eigenvalues and unit eigenvectors (rows) of their covariance, all of them."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(self.eigenvalues.sum())

    def explained(self) -> list[float]:
        """Share of the variance of each component; zeros if there is none."""
        return [float(e / self.trace) if self.trace else 0.0 for e in self.eigenvalues]

    def project(self, rows: np.ndarray, components: int) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        e = self.eigenvalues[:components]
        return centred(rows, self.n, self.sums) @ self.vectors[:components].T / np.where(e > 0, np.sqrt(e), np.nan)


def fit_whitening(distinct: DataFrame, dims: int) -> Whitening | None:
    """Fit on the vectors ``x``, each as often as it comes; ``None`` if there are none.

    What reaches the driver is one summary.
    """
    parts = cut(_summarised(distinct, dims))
    last = parts.agg(F.max("pid")).first()[0]
    if last is None:
        return None
    while last > 0:
        parts = cut(parts.withColumn("up", F.expr(f"cast(pid div {FAN_IN} as int)")).groupBy("up").applyInArrow(_merged, _SUMMARY))
        last //= FAN_IN
    row = parts.first()
    n, scaled = row["n"], np.array(row["scaled"]).reshape(-1, dims)
    _, s, vt = np.linalg.svd(np.vstack([scaled, np.zeros((max(0, dims - len(scaled)), dims))]))
    s = np.where(s > _ZERO * s[0], s, 0.0) if len(s) else s
    # either sign will do; the greatest entry is positive, so that a second fit gives the same
    top = vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)]
    return Whitening(n, [int(x) for x in row["sums"]], s**2 / n, vt * np.where(top < 0, -1.0, 1.0)[:, None])


def identity_error(distinct: DataFrame, dims: int, fitted: Whitening, components: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, over the components with variance.

    Sums of products by partition, added up in Spark entry by entry.
    """
    k = int((fitted.eigenvalues[:components] > 0).sum())
    if not k:
        return None
    shared = distinct.sparkSession.sparkContext.broadcast(fitted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                z = shared.value.project(_matrix(batch.column(0), dims), k)
                total += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    rows = distinct.select("x").mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    total = np.array([r["value"] for r in rows]).reshape(k + 1, k) / fitted.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of each row that has a sound vector.

    ``whitened`` and ``explained`` are arrays with one entry for each of the
    first ``components`` components (all, if there are fewer dimensions).  The
    fit takes each distinct vector once.

    Rows go whose vector is null or empty, or has an entry that is null, not
    finite or not below 2^46 in size (no exact whole number); rows with
    another number of dimensions than most have (the smaller one of equally
    frequent ones) go, too.  Null and repeated ids stay, each with its row.
    A component without variance, as all are with a single distinct vector,
    has null as ``whitened`` and 0 as ``explained``; ``identity_error`` is over the others, null
    if there are none.  ``deviation`` is null where it exceeds a long.  No
    sound rows, no result rows; other columns take no part.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col(id).alias("id"), whole(F.col(embedding)).alias("x")).where("x is not null"), [])
    usual = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.col("count").desc(), "dims").limit(1).collect()
    dims = usual[0]["dims"] if usual else 1
    rows = rows.where(F.size("x") == dims)
    distinct = written(rows.select("x").distinct(), [])
    fitted = fit_whitening(distinct, dims)
    if fitted is None:
        schema = f"`{id}` {vectors.schema[id].dataType.simpleString()}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
        return spark.createDataFrame([], schema)
    k = min(components, dims)
    error = identity_error(distinct, dims, fitted, k)
    shared = spark.sparkContext.broadcast(fitted)

    @F.arrow_udf("deviation bigint, whitened array<double>")
    def applied(x: pa.Array) -> pa.Array:
        model, entries = shared.value, _matrix(x, dims)
        away = deviations(entries, model.n, model.sums)
        if away.dtype != object and len(away) and int(np.abs(away).max()) >= int((2**62 / dims) ** 0.5):
            away = away.astype(object)
        squares = [int(v) if v < 2**63 else None for v in (away**2).sum(axis=1)]
        z = model.project(entries, k)
        lists = pa.ListArray.from_arrays(pa.array(range(0, len(z) * k + 1, k), pa.int32()), pa.array(z.ravel(), from_pandas=True))
        return pa.StructArray.from_arrays([pa.array(squares, pa.int64()), lists], names=["deviation", "whitened"])

    made = rows.select(F.col("id").alias(id), applied.asNondeterministic()(F.col("x")).alias("made"))
    explained = F.array(*[F.lit(v) for v in fitted.explained()[:k]])
    return made.select(id, F.lit(fitted.n).cast("bigint").alias("n"), "made.deviation", "made.whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
