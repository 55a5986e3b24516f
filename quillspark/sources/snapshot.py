"""Snapshots: staged writes, checks before the swap, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.joins import unpivot_ids

#: A provider snapshot with fewer rows is taken for broken.
LEAST_ROWS = 100_000


class BrokenSnapshot(ValueError):
    """A staged snapshot that failed its check; the current one stays."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, path: str) -> str | None:
    """Name of the current version of a published table, null if there is none."""
    pointer, fs = _fs(spark, f"{path.rstrip('/')}/CURRENT")
    if not fs.exists(pointer):
        return None
    source = fs.open(pointer)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    file, fs = _fs(spark, path)
    out = fs.create(file)
    out.write(bytearray(text.encode()))
    out.close()


def _rename_pointer(spark: SparkSession, base: str, name: str) -> None:
    """Let the pointer file of ``base`` name something else, by one rename."""
    staged = f"{base}/.CURRENT-{uuid.uuid4().hex}"
    _write(spark, staged, name)
    path, fs = _fs(spark, staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(path), fs.makeQualified(_fs(spark, f"{base}/CURRENT")[0]), overwrite)


def point_to(spark: SparkSession, base: str, name: str, text: str) -> None:
    """Write a small file below ``base`` and let the pointer name it."""
    _write(spark, f"{base}/{name}", text)
    _rename_pointer(spark, base, name)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The published table, null if nothing was published yet."""
    version = _read_pointer(spark, path)
    return None if version is None else spark.read.parquet(f"{path.rstrip('/')}/{version}")


def publish(df: DataFrame, path: str, least: int = LEAST_ROWS, keep: int = 2) -> int:
    """Writes a new version below ``path``, checks its number of rows, then points to it; returns the rows.

    A version is a folder of its own and never changes; the small pointer file
    is replaced by one rename, so there is a table at any moment and a crash
    leaves the former one.  Readers that have opened a version keep it: the
    newest ``keep`` versions stay, older ones go.  Works on any file system
    that Spark writes to.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    before = _read_pointer(spark, base)
    number = 1 + (int(before.split("-")[1]) if before else 0)
    version = f"version-{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{version}")
    rows = spark.read.parquet(f"{base}/{version}").count()
    made, fs = _fs(spark, f"{base}/{version}")
    if rows < least:
        fs.delete(made, True)
        raise BrokenSnapshot(f"{rows} rows, at least {least} expected")
    _rename_pointer(spark, base, version)
    versions = sorted(f.getPath().getName() for f in fs.listStatus(made.getParent()) if f.getPath().getName().startswith("version-") and int(f.getPath().getName().split("-")[1]) <= number)
    for name in versions[:-keep]:
        fs.delete(_fs(spark, f"{base}/{name}")[0], True)
    return rows


def by_id(dump: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the wanted ids (``external_id`` text); texts that are no numbers and gone records find nothing."""
    keys = wanted.select(F.col("external_id").try_cast("bigint").alias("id")).where("id is not null").distinct()
    live = dump.where(F.col("state").isNull() | ~F.col("state").isin("merged", "deleted"))
    return live.join(keys, "id", "left_semi")


def by_source(dump: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Index of the ids of other providers: ``provider``, ``external_id``, ``id``; active records first."""
    return unpivot_ids(dump, "id", columns, "state")
