"""Keyed tables that change bucket by bucket and several at a time.

A table is dealt into buckets by a hash of its key.  A change reads and
rewrites only the buckets of the keys that it brings; what a set of tables
consists of is one small list of folders (a state), and one rename makes a new
state the current one.  So a change to several tables is seen whole or not at
all, a crash before the rename leaves the former state, and a numbered change
that was made already is skipped: exactly once, however often it is tried.

States and folders never change once written.  One writer at a time is
expected; readers keep the state that they have opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.sources.snapshot import _fs, _read_pointer, point_to

BUCKETS = 256
#: States whose folders are kept for readers that have them open.
KEEP = 2

#: Stored rows of the touched buckets (or none), the incoming rows: the new rows of those buckets.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Change:
    """What a commit does to one table: ``incoming`` rows, merged by ``merge`` into the stored ones with the same ``keys``.

    ``merge`` gets all stored rows of the touched buckets, so also some whose
    keys are not among the incoming ones, and returns what they become.
    """

    keys: list[str]
    incoming: DataFrame
    merge: Merge


class TableSet:
    """A set of keyed tables below one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def state(self) -> dict:
        """``version``, ``batches`` (last number of each stream of changes), ``tables`` (keys, number of buckets and their folders)."""
        name = _read_pointer(self.spark, self.path)
        if name is None:
            return {"version": 0, "batches": {}, "tables": {}, "before": []}
        file, fs = _fs(self.spark, f"{self.path}/{name}")
        source = fs.open(file)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def bucket_of(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _rows(self, table: dict, numbers: list[int] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/{f}" for n, f in table["folders"].items() if numbers is None or int(n) in numbers]
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        """The current rows of a table; ``None`` if there is no such table."""
        table = (state or self.state())["tables"].get(name)
        return None if table is None else self._rows(table)

    def lookup(self, name: str, wanted: DataFrame) -> DataFrame | None:
        """Rows whose key is among ``wanted`` (the key's columns); reads their buckets only."""
        table = self.state()["tables"].get(name)
        if table is None:
            return None
        keys = table["keys"]
        return self._rows(table, self._touched(wanted, keys, table["buckets"])).join(wanted.select(*keys).distinct(), keys, "left_semi")

    def _touched(self, rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
        """Buckets of the rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket_of(keys, buckets)).distinct().collect())

    def done(self, stream: str, number: int) -> bool:
        """Whether a numbered change was made already."""
        return self.state()["batches"].get(stream, -1) >= number

    def commit(self, stream: str, number: int, changes: dict[str, Change]) -> bool:
        """Make the changes together, as number ``number`` of ``stream``; false, and nothing done, if it was made before.

        Incoming frames are read twice, so they should be settled.
        """
        state = self.state()
        if state["batches"].get(stream, -1) >= number:
            return False
        version = state["version"] + 1
        tables = dict(state["tables"])
        for name, change in changes.items():
            tables[name] = self._changed(name, tables.get(name), change, f"{name}/{version:012d}-{uuid.uuid4().hex}")
        folders = {f for t in state["tables"].values() for f in t["folders"].values()}
        new = {"version": version, "batches": state["batches"] | {stream: number}, "tables": tables, "before": [sorted(folders), *state["before"]][:KEEP]}
        point_to(self.spark, self.path, f"state-{version:012d}-{uuid.uuid4().hex}.json", json.dumps(new))
        self._forget(state, new)
        return True

    def _changed(self, name: str, table: dict | None, change: Change, folder: str) -> dict:
        schema = change.incoming.schema
        if table is None:
            table = {"keys": change.keys, "buckets": self.buckets, "schema": json.loads(schema.json()), "folders": {}}
        if table["keys"] != change.keys:
            raise ValueError(f"{name} is keyed by {table['keys']}")
        buckets = table["buckets"]
        touched = self._touched(change.incoming, change.keys, buckets)
        stored = self._rows(table, touched)
        made = change.merge(stored, change.incoming)
        row = self.bucket_of(change.keys, buckets)
        if touched:
            # a large bucket is written by several tasks
            made.withColumn("_bucket", row).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        _, fs = _fs(self.spark, f"{self.path}/{folder}")
        left = {n: f for n, f in table["folders"].items() if int(n) not in touched}
        for n in touched:  # a bucket that lost its last row has no folder
            if fs.exists(_fs(self.spark, f"{self.path}/{folder}/_bucket={n}")[0]):
                left[str(n)] = f"{folder}/_bucket={n}"
        return table | {"schema": json.loads(made.schema.json()), "folders": left}

    def _forget(self, old: dict, new: dict) -> None:
        """Delete folders that no kept state names any more."""
        kept = {f for t in new["tables"].values() for f in t["folders"].values()} | {f for before in new["before"] for f in before}
        for f in {f for before in old["before"] for f in before} - kept:
            path, fs = _fs(self.spark, f"{self.path}/{f}")
            fs.delete(path, True)

    def clean(self) -> int:
        """Delete states that were replaced, and folders that a change left behind when it did not get to its rename.

        Call it while nobody writes; returns the number of folders.
        """
        state = self.state()
        now, (top, fs) = _read_pointer(self.spark, self.path), _fs(self.spark, self.path)
        for found in fs.listStatus(top) if fs.exists(top) else ():
            name = found.getPath().getName()
            if name != now and name.startswith(("state-", ".CURRENT-")):
                fs.delete(found.getPath(), True)
        named = {f.rsplit("/", 1)[0] for t in state["tables"].values() for f in t["folders"].values()} | {f.rsplit("/", 1)[0] for before in state["before"] for f in before}
        gone = 0
        for name in state["tables"]:
            top, fs = _fs(self.spark, f"{self.path}/{name}")
            for found in fs.listStatus(top) if fs.exists(top) else ():
                if f"{name}/{found.getPath().getName()}" not in named:
                    fs.delete(found.getPath(), True)
                    gone += 1
        return gone


def replaced(keys: list[str]) -> Merge:
    """Incoming rows take the place of stored ones with their key; one row a key is expected."""
    return lambda stored, incoming: stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def kept_first(keys: list[str]) -> Merge:
    """Stored rows stay; incoming ones with a new key are added, one a key."""
    return lambda stored, incoming: stored.unionByName(incoming.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys))
