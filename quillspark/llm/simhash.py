"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at
most ``d`` bits differ in at most ``d`` bytes, so they share at least ``8 - d``
positional bytes: that is the guaranteed count.  The index lists fingerprints
under sets of positional bytes, chosen so that any ``8 - d`` positions hold one
of the sets; with d = 4 these are 20 sets of three positions instead of the
eight single ones, which shortens the posting lists from N/256 to N/2^24 on
random fingerprints and loses no pair.  For each pair that meets in a posting
list the shared positional bytes are tallied, pairs below the guaranteed count
are dropped, and the Hamming distance of the rest is verified.

Equal fingerprints are one node from the start.  A posting list first links
its members to its smallest one; only lists that still hold more than one
component compare members of different components, so a list of thousands of
near copies makes a number of links in proportion to its length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import connected_components, cut

BYTES = 8
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of ``width``-word shingles, repeats counted.

    A-Z are lower-cased; words are runs without ASCII white space.  Fewer words
    than ``width``: the whole sequence is the one shingle.  No word, or null: 0.
    """
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash_of(text: Column, width: int = 4) -> Column:
    """:func:`simhash` as a signed ``bigint`` column (the same 64 bits)."""

    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        values = np.fromiter((simhash(t, width) for t in texts.to_pylist()), dtype=np.uint64, count=len(texts))
        return pa.array(values.view(np.int64), pa.int64())

    return fingerprint(text)


def position_sets(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``8 - distance`` equal positions hold one of them.

    For four or more equal positions: Turan's system of 20 threes over groups
    {0,1,2}, {3,4,5}, {6,7} (a whole group, or two of a group and one of the
    next).  For three: the pairs within two groups of four.  Otherwise single
    positions.
    """
    if not 0 <= distance < BYTES:
        raise ValueError("distance must be 0 to 7")
    shared = BYTES - distance
    if shared >= 4:
        group = (0, 0, 0, 1, 1, 1, 2, 2)
        sets = []
        for three in combinations(range(BYTES), 3):
            n = [sum(group[p] == g for p in three) for g in range(3)]
            if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
                sets.append(three)
        return sets
    if shared == 3:
        return [pair for half in (range(4), range(4, 8)) for pair in combinations(half, 2)]
    return [(p,) for p in range(BYTES)]


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def _key(fingerprint: Column, positions: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("bigint")
    for p in positions:
        key = key * 256 + _byte(fingerprint, p)
    return key


def _close(a: str, b: str, distance: int) -> Column:
    """Count filter, then the exact distance."""
    differs = F.col(a).bitwiseXOR(F.col(b))
    tally = sum((F.when(_byte(differs, p) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))
    return (tally >= BYTES - distance) & (F.bit_count(differs) <= distance)


def near_components(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Link distinct fingerprints at ``distance`` or fewer differing bits.

    ``nodes``: ``node`` long, ``fp`` bigint, one row per distinct fingerprint.
    Returns ``node``, ``component`` for nodes that have a link.
    """
    sets = position_sets(distance)
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), _key(F.col("fp"), s).alias("key")) for i, s in enumerate(sets)]))
    postings = nodes.select("node", "fp", listed.alias("e")).select("node", "fp", "e.pos", "e.key")
    leaders = (
        postings.groupBy("pos", "key")
        .agg(F.min(F.struct("node", "fp")).alias("lead"), F.max("node").alias("last"))
        .where("lead.node < last")
        .select("pos", "key", F.col("lead.node").alias("lead"), F.col("lead.fp").alias("lead_fp"))
    )
    shared = cut(postings.join(leaders, ["pos", "key"]))
    first = shared.where(F.col("node") != F.col("lead")).where(_close("fp", "lead_fp", distance))
    label = cut(connected_components(first.select(F.col("node").alias("a"), F.col("lead").alias("b"))))
    # lists whose members are not all in one component yet: compare across components
    member = shared.select("pos", "key", "node", "fp").join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mixed = member.groupBy("pos", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("pos", "key")
    left = member.join(mixed, ["pos", "key"])
    right = left.select("pos", "key", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    across = left.join(right, ["pos", "key"]).where("label < label2").where(_close("fp", "fp2", distance)).select(F.col("label").alias("a"), F.col("label2").alias("b"))
    known = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(known.unionByName(across.distinct()))


def _components(prints: DataFrame, distance: int) -> DataFrame:
    """``fp``, ``component`` (a fingerprint) of every distinct ``fp``; each fingerprint is its own node."""
    nodes = cut(prints.select("fp", F.col("fp").alias("node")).distinct())
    linked = near_components(nodes, distance)
    return nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))


def simhash_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``id``, ``fp`` (bigint) and ``component_id`` of each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; rows
    with equal fingerprints are one component; a row whose id is null keeps a
    fingerprint and has the component of its fingerprint, named by its smallest
    id (null if no row of it has one).  Rows of one id with different texts
    don't link their components.  Empty tables give no rows.  Only the id and
    the fingerprint are shuffled, never the text.
    """
    prints = cut(docs.select(F.col(id).alias("id"), simhash_of(F.col(text), width).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    named = cut(_components(prints, distance).join(least, "fp"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(first, "component"), "fp").select(F.col("id").alias(id), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, null last.

    Among rows of one id the hash of the text decides.  Equal rows of one id
    count as copies: one of them stays.  All columns stay, whatever their names.
    """
    key = [F.col(id).isNull().alias("_null"), F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_said")]
    rows = docs.select(F.struct(key[0], F.col(id).alias("id"), key[2], key[1]).alias("row"), simhash_of(F.col(text), width).alias("fp"))
    prints = cut(rows.groupBy("fp").agg(F.min("row").alias("row")))
    first = prints.join(_components(prints, distance), "fp").groupBy("component").agg(F.min("row").alias("row"))
    kept = first.select("row._null", "row._id", "row._said")
    names = ["_null", "_id", "_said"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    return packed.join(kept, names, "left_semi").dropDuplicates(names).select("row.*")
