"""Cutting a plan's lineage at a table that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one ``spark.checkpoint.dir`` names.

    Only in local mode, where driver and executor are one, may it be unset; a
    temporary one is taken then.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/quillspark-{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as a shuffle has.

    For costly expressions on narrow tables: a few compressed megabytes may
    hold millions of rows, and a scan of them has only a task or two.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, and read from there.

    Spark goes on estimating its size by the files that it came from, which
    are compressed and before any list was opened; so joins are told to sort
    and merge it, and it is not sent through the driver.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True).hint("merge")
