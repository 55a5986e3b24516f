"""Connected components and blocked comparison, shared by the near-duplicate operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: the one ``spark.checkpoint.dir`` names.

    Only in local mode, where driver and executor are one, may it be unset; a
    temporary one is taken then.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back; the rows survive the loss of any executor.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes them when they are no longer used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, random: list[str]) -> DataFrame:
    """A wide intermediate table as Parquet in the shared folder, so that later steps read only their columns.

    No dictionary is tried for columns whose values are ``random``, as hashes are.
    """
    path = f"{shared_folder(df.sparkSession)}/quillspark-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in random}).parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.parquet(path)


#: Tables of this process that :func:`written` made.
_WRITTEN: list[str] = []


def written_so_far() -> set[str]:
    """Paths of the tables that :func:`written` made and nobody dropped."""
    return set(_WRITTEN)


def drop_written(spark: SparkSession, paths: set[str] | None = None) -> int:
    """Delete tables that :func:`written` made, all or the named ones; call it when their results are no longer read."""
    gone = [p for p in _WRITTEN if paths is None or p in paths]
    for p in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(p)
    return len(gone)


def _stamp(edges: DataFrame) -> tuple:
    """Order-independent digest of a set of edges: two numbers, whatever its size."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 40, enough: int | None = None) -> DataFrame:
    """Smallest reachable node of each node that has an edge.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and self
    loops do not matter.  Returns ``node``, ``component``: one row for each
    node of an edge between two different nodes.  Empty edges give no rows.
    With ``enough``, stops after so many rounds: nodes with one label are then
    surely connected, but a component may still have several.

    Alternating large-star and small-star rounds; the edge set is cut after
    each.  Aggregations combine on the map side.  In a join the neighbours of
    one node meet a single row of the other side, so a hub's partition can be
    split there by adaptive execution's skew join without gathering.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    stamp = _stamp(edges)
    for done in range(1, max_rounds + 1):
        if not stamp[0]:
            break
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of u, and u itself, point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if enough is not None and done >= enough:
            break
        before, stamp = stamp, _stamp(edges)
        if before == stamp:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return labels.groupBy("node").agg(F.min("component").alias("component"))


def comparison_blocks(rows: DataFrame, keys: list[str], spread: str, block: int) -> DataFrame:
    """Rows of buckets with two or more rows, dealt into block pairs of bounded size.

    A bucket of n rows is split by a hash of ``spread`` into s = ceil(n/block)
    parts; a row goes to the s pairs that its part takes part in (columns
    ``part``, ``lo``, ``hi``), so every pair of rows of a bucket meets, and no
    pair of parts holds more than about two blocks.  ``rows`` should be narrow:
    what is compared is joined to the result, see :func:`gathered`.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("bucket_n")).where("bucket_n > 1")
    parts = F.ceil(F.col("bucket_n") / F.lit(block)).cast("int")
    return (
        rows.join(counts, keys)
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64(spread), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("other", "bucket_n", "parts")
    )


def gathered(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks brought together: sorted by bucket and pair of parts within partitions."""
    group = [*keys, "lo", "hi"]
    return blocks.repartition(*group).sortWithinPartitions(*group)


def each_run(blocks: DataFrame, keys: list[str], schema: str, compare: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Call ``compare`` once for each run of equal ``keys`` + (lo, hi).

    The input comes from :func:`gathered`; runs may cross Arrow
    batches, and only the run at the end of a batch is carried over.
    """
    names = [*keys, "lo", "hi"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            ends = _run_ends(table, names)
            start = 0
            for end in ends[:-1]:
                yield from compare(table.slice(start, end - start))
                start = end
            held = table.slice(start).combine_chunks()
        if held is not None and held.num_rows:
            yield from compare(held)

    return blocks.mapInArrow(work, schema)


def _run_ends(table: pa.Table, names: list[str]) -> list[int]:
    if not table.num_rows:
        return [0]
    change = np.zeros(table.num_rows - 1, dtype=bool)
    for name in names:
        values = table.column(name).to_numpy()
        change |= values[1:] != values[:-1]
    return [*(np.flatnonzero(change) + 1).tolist(), table.num_rows]


def forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph on 0..n-1: at most n-1 edges for any number of pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def spark_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
