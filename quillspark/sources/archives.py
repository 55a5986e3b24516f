"""Packed dumps: digest against a side file, first member unpacked to lines.

A dump is one packed file, which can't be split: one task streams it, and what
it yields are rows that Spark deals out from then on.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.lineage import settled
from quillspark.sources.tables import Change, TableSet, replaced

#: Bytes of a chunk, lines of a batch.
CHUNK, LINES = 1 << 20, 10_000


class DigestWarning(UserWarning):
    """A dump whose digest is not that of its side file, or that has none."""


def digest_of(spark: SparkSession, path: str) -> str:
    """SHA-1 of a file as lowercase hex, chunk after chunk in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                view, found = memoryview(content.as_buffer()), hashlib.sha1(usedforsecurity=False)
                for at in range(0, len(view), CHUNK):
                    found.update(view[at : at + CHUNK])
                yield pa.RecordBatch.from_arrays([pa.array([found.hexdigest()])], names=["digest"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "digest string").first()[0]


def expected_digest(spark: SparkSession, path: str) -> str | None:
    """The first word of a side file, in lower case; null if there is no such file or it is blank."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    file = jvm.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return None
    words = " ".join(r[0] for r in spark.read.text(path).limit(1).collect()).split()
    return words[0].lower() if words else None


def member_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines of the first regular file in a tar archive, packed or not; later members are not read.

    An archive without a regular file gives no lines; blank lines are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with tarfile.open(fileobj=io.BufferedReader(pa.BufferReader(content.as_buffer())), mode="r:*") as archive:
                    member = next((m for m in archive if m.isreg()), None)
                    if member is None:
                        continue
                    lines: list[str] = []
                    for line in io.TextIOWrapper(archive.extractfile(member), "utf-8", errors="replace"):
                        if line.strip():
                            lines.append(line.rstrip("\r\n"))
                        if len(lines) >= LINES:
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])
                            lines = []
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "line string")


def refresh(tables: TableSet, number: int, provider: str, path: str, schema: str, target: str, now: int, least: int = 1) -> bool:
    """Refresh a provider's table from its dump: publish it below ``target``, and commit its state and a run row.

    A broken dump leaves the published table, and its run row says so.  A
    number that was committed is skipped; if the run failed between publishing
    and committing, the same content is published again.
    """
    from quillspark.sources import snapshot

    spark, stream = tables.spark, f"refresh:{provider}"
    if tables.done(stream, number):
        return False
    version, rows, error = None, None, None
    try:
        records = load_dump(spark, path, schema, least=least)
        version = digest_of(spark, path)
        rows = snapshot.publish(records, target, least)
    except snapshot.BrokenSnapshot as broken:
        error = str(broken)
    run = spark.createDataFrame([(f"{provider}/{number}", provider, now, "failure" if error else "success", rows, error)], "run string, provider string, started_at bigint, status string, records bigint, error string")
    changes = {"provider_refreshes": Change(["run"], run, replaced(["run"]))}
    if error is None:
        state = spark.createDataFrame([(provider, now, version, rows)], "provider string, refreshed_at bigint, version string, records bigint")
        changes["provider_cache_state"] = Change(["provider", "refreshed_at"], state, replaced(["provider", "refreshed_at"]))
    return tables.commit(stream, number, changes)


def load_dump(spark: SparkSession, path: str, schema: str, side: str | None = None, least: int = 1) -> DataFrame:
    """Records of a packed dump of JSON lines, after its checks.

    A digest that is not the side file's (``path`` with ``.sha1`` unless
    given), or a missing one, warns: the publisher may have replaced either
    alone.  What counts is the content: fewer than ``least`` records that have
    an ``id`` are an error.
    """
    from quillspark.sources.snapshot import BrokenSnapshot

    wanted = expected_digest(spark, side or f"{path}.sha1")
    if wanted is None:
        warnings.warn(f"{path}: no digest to compare with", DigestWarning, stacklevel=2)
    elif (found := digest_of(spark, path)) != wanted:
        warnings.warn(f"{path}: digest {found}, expected {wanted}", DigestWarning, stacklevel=2)
    records = settled(member_lines(spark, path).select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("id is not null"))
    rows = records.count()
    if rows < least:
        raise BrokenSnapshot(f"{rows} records, at least {least} expected")
    return records
