"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors at cosine c are sqrt(2 - 2c) apart, and the projections of
two vectors on a Gaussian direction differ by a normal variate of that scale.
A hash is a projection shifted and divided into cells of fixed width; a bucket
is the cells of several projections; several tables of buckets make it likely
that every close pair shares one.  All pairs of a bucket are then compared by
exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.graph import comparison_blocks, connected_components, cut, each_run, forest, gathered

#: About the width that needs fewest tables: unit vectors at cosine 0.95 are 0.32 apart, unrelated ones 1.41.
WIDTH = 2.0
BLOCK = 1024


def same_cell(width: float, distance: float) -> float:
    """Chance that two points at ``distance`` share a cell of one projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    """Number of tables and of projections in each, and the seed of the directions."""

    tables: int
    projections: int
    seed: int = 42

    @staticmethod
    def plan(rows: int, cosine: float, miss: float = 2e-4, width: float = WIDTH) -> Tables:
        """Projections so that unrelated vectors seldom meet among ``rows``; then as many
        tables as keep the chance to miss a pair right at the threshold below ``miss``."""
        near = same_cell(width, math.sqrt(2 - 2 * cosine))
        unrelated = same_cell(width, math.sqrt(2))
        k = max(2, math.ceil(math.log(max(rows, 64) / 64) / -math.log(unrelated)))
        return Tables(max(1, math.ceil(math.log(miss) / math.log1p(-(near**k)))), k)

    def buckets(self, unit: np.ndarray, width: float = WIDTH, upto: int | None = None) -> np.ndarray:
        """Bucket of each unit vector in each table: int64 of shape (rows, tables)."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        ways = rng.standard_normal((unit.shape[1], self.tables * self.projections))
        shift = rng.uniform(0, width, self.tables * self.projections)
        mix = rng.integers(1, 2**62, self.tables * self.projections, dtype=np.int64) * 2 + 1
        n = (self.tables if upto is None else upto) * self.projections
        cells = np.floor((unit @ ways[:, :n] + shift[:n]) / width).astype(np.int64)
        with np.errstate(over="ignore"):
            return (cells * mix[:n]).reshape(len(unit), -1, self.projections).sum(axis=2)


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not the zero vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` of each row of ``vectors``.

    Equal vectors are one class, compared once and counted with its size; a
    class has a number of its own, so what its rows are called doesn't matter.
    ``n_links`` counts rows: a row that is there twice links with its double,
    and rows of one id with different vectors are different ones.
    Vectors that :func:`usable` refuses, and vectors of another dimension, link
    with nothing.  A row whose id is null is left out of linking and keeps a
    null component.  Empty tables give no rows.

    Buckets are dealt out as numbers; a vector itself moves to each pair of
    blocks in which it is compared, so once for each table that it meets
    another one in.
    """
    kind = vectors.schema[vector].dataType.elementType
    code = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    good = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    classes = cut(good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("mult")).withColumn("rep", F.monotonically_increasing_id()))
    plan = Tables.plan(classes.count(), cosine)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            lists = batch.column("v")
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(code)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                keys = plan.buckets(_unit(np.stack([flat[starts[i] : starts[i + 1]] for i in at])))
                for t in range(plan.tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(keys[:, t]), pa.array(reps[at])],
                        names=["t", "dim", "key", "rep"],
                    )

    def compare(run: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = _unit(run.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(code).reshape(run.num_rows, -1))
        t, lo, hi = (run.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        part = run.column("part").to_numpy()
        first, second = (np.arange(len(unit)),) * 2 if lo == hi else (np.flatnonzero(part == lo), np.flatnonzero(part == hi))
        x, y = np.nonzero(unit[first] @ unit[second].T >= cosine)
        if lo == hi:
            x, y = x[x < y], y[x < y]
        x, y = first[x], second[y]
        if not len(x):
            return
        if t:  # a pair counts in the first table in which it meets
            near = np.unique(np.concatenate([x, y]))
            earlier = plan.buckets(unit[near], upto=t)
            fresh = np.ones(len(x), dtype=bool)
            a, b = np.searchsorted(near, x), np.searchsorted(near, y)
            for j in range(t):
                fresh &= earlier[a, j] != earlier[b, j]
            x, y = x[fresh], y[fresh]
            if not len(x):
                return
        rep, mult = run.column("rep").to_numpy(), run.column("mult").to_numpy()
        links = np.bincount(x, weights=mult[y], minlength=len(rep)) + np.bincount(y, weights=mult[x], minlength=len(rep))
        leaf, root = forest(x, y, len(rep))
        to = np.arange(len(rep))
        to[leaf] = root
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[to[some]])], names=["rep", "links", "other"])

    listed = cut(classes.select("rep", "v").mapInArrow(spread, "t int, dim int, key long, rep long"))
    keys = ["t", "dim", "key"]
    blocks = gathered(comparison_blocks(listed, keys, "rep", BLOCK).join(classes.select("rep", "mult", "v"), "rep"), keys)
    linked = cut(each_run(blocks, keys, "rep long, links long, other long", compare))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(linked.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component"))
    first = named.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(first, "component", "left").select("v", "n_links", F.coalesce("first", "least").alias("component_id"))
    linked_rows = good.join(named, "v").select("id", "n_links", "component_id")
    alone = rows.where(F.col("id").isNull() | ~usable(F.col("v"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
