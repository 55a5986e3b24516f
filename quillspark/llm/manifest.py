"""Merkle manifest of a dataset: a tree for each source, and one over their roots.

Leaves are digests of rows.  They are range-sorted by (source, id), so a source
is a run of partitions, and one count for each partition gives every leaf its
place in its source.  Each partition hashes the aligned subtrees that lie in it
whole; the nodes at its ragged ends, whose sixteen reach into a neighbour, are
shuffled by (source, level, place) and their levels finished there.  A second
pass over the sorted leaves walks from each leaf to the root, through its own
partition's subtrees and then the finished levels, which reach the partition
by its number.

What the driver holds is one short row for each partition (first and last
source with their counts), and the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.graph import cut

#: Nodes under one parent.
RUN = 16
#: Leaves of a partition, about; a partition's digests are held in memory.
LEAVES = 100_000

ROW = "key string, doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PROOF = "array<struct<at:int,siblings:array<string>>>"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def counted(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(counted, columns)), 256)


def _source_key(source: Column) -> Column:
    """A name that is never null and sorts as sources do, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def range_sorted(rows: DataFrame, order: list[str], size: int = LEAVES) -> DataFrame:
    """Rows range-sorted by ``order`` and then at random, with the number ``pid`` of their partition; written to the shared folder.

    The random number lets even rows that are wholly equal be split.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // size))
    dealt = rows.withColumn("tie", F.rand(42)).repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order, "tie")
    return cut(dealt.drop("tie").withColumn("pid", F.spark_partition_id()))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last key of a partition with their numbers of rows."""
    runs: list[list] = []
    pid = None
    for batch in batches:
        if batch.num_rows:
            pid = batch.column(1)[0].as_py()
        for key, group in groupby(batch.column(0).to_pylist()):
            n = sum(1 for _ in group)
            if runs and runs[-1][0] == key:
                runs[-1][1] += n
            else:
                runs[1:] = [[key, n]]
                if len(runs) == 2 and runs[0][0] == key:
                    del runs[1]
    if runs:
        row = {"pid": pid, "first": runs[0][0], "n_first": runs[0][1], "last": runs[-1][0], "n_last": runs[-1][1]}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("pid", pa.int32()), ("first", pa.string()), ("n_first", pa.int64()), ("last", pa.string()), ("n_last", pa.int64())]))


def partition_ends(ordered: DataFrame, key: str) -> dict[int, tuple[int, int, int]]:
    """For each partition: the place of its first row in its key, the rows of its first key, those of its last key.

    One row for each partition reaches the driver.
    """
    found = ordered.select(key, "pid").mapInArrow(_ends, "pid int, first string, n_first bigint, last string, n_last bigint").collect()
    found = sorted(map(tuple, found))
    before, totals, running = {}, {}, None
    for pid, first, n_first, last, n_last in found:
        running = running if running and running[0] == first else [first, 0]
        before[pid] = running[1]
        running[1] += n_first
        totals[first] = running[1]
        if last != first:
            running = [last, n_last]
            totals[last] = n_last
    return {pid: (before[pid], totals[first], totals[last]) for pid, first, _, last, _ in found}


def sizes(n: int) -> list[int]:
    """Numbers of nodes level by level, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // RUN))
    return out


def local_levels(leaves: list[str], at: int, n: int) -> list[tuple[int, list[str]]]:
    """The nodes that follow from leaves ``at``, ``at + 1``, ... of ``n``: place of the first and digests, level by level."""
    levels = [(at, leaves)]
    for count in sizes(n)[:-1]:
        start, nodes = levels[-1]
        end = start + len(nodes)
        low = -(-start // RUN)
        high = -(-end // RUN) if end == count else end // RUN
        if low >= high:
            break
        levels.append((low, [digest("".join(nodes[r * RUN - start : (r + 1) * RUN - start])) for r in range(low, high)]))
    return levels


def _whole(run: int, start: int, nodes: list[str], count: int) -> bool:
    return start <= run * RUN and min(count, (run + 1) * RUN) <= start + len(nodes)


def _held(rows: list[tuple], ends: tuple[int, int, int]) -> Iterator[tuple[str, list[tuple], int, int]]:
    """The keys of a partition with their rows, the place of the first one and the rows of the key everywhere."""
    groups = [(key, list(group)) for key, group in groupby(rows, key=lambda r: r[0])]
    before, n_first, n_last = ends
    for i, (key, group) in enumerate(groups):
        n = n_first if i == 0 else n_last if i == len(groups) - 1 else len(group)
        yield key, group, before if i == 0 else 0, n


def boundary_nodes(ordered: DataFrame, ends) -> DataFrame:
    """What each partition can't finish: nodes of runs that reach beyond it; and the roots of keys that it holds whole.

    ``pid``, ``key``, ``n`` (leaves of the key), ``level``, ``idx``, ``digest``.
    """
    names = ["pid", "key", "n", "level", "idx", "digest"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pid = [], None
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            pid = batch.column(2)[0].as_py() if batch.num_rows else pid
        out = []
        for key, group, at, n in _held(rows, ends.value[pid]) if rows else ():
            counts = sizes(n)
            for level, (start, nodes) in enumerate(local_levels([leaf for _, leaf in group], at, n)):
                if counts[level] == 1:
                    out.append((pid, key, n, level, 0, nodes[0]))
                    continue
                places = range(start, start + len(nodes))
                runs = {places[0] // RUN, places[-1] // RUN} if nodes else ()
                ragged = [r for r in sorted(runs) if not _whole(r, start, nodes, counts[level])]
                out += [(pid, key, n, level, p, nodes[p - start]) for r in ragged for p in range(max(start, r * RUN), min(start + len(nodes), (r + 1) * RUN))]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return cut(ordered.select("key", "leaf", "pid").mapInArrow(work, "pid int, key string, n bigint, level int, idx bigint, digest string"))


def _parent(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _runs(nodes: DataFrame, *by: str) -> DataFrame:
    """Sixteen neighbours each: ``run``, ``digests`` in order.  A group has at most sixteen rows."""
    joined = nodes.groupBy(*by, F.expr(f"idx div {RUN}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("d"))
    return joined.select(*by, "run", F.col("d.digest").alias("digests"))


def finish_levels(boundary: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Levels above the ragged nodes: the roots (``key``, ``digest``), and the runs that each partition's walks need.

    ``most`` is the greatest number of leaves of a key.  The runs come as
    ``pid``, ``key``, ``level``, ``run``, ``digests``.
    """
    depth = len(sizes(most)) - 1
    counts = F.col("n")
    nodes, want, roots, needed = None, None, None, None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for level in range(depth + 1):
        own = boundary.where(F.col("level") == level)
        nodes = add(nodes, own.select("key", "n", "idx", "digest"))
        single = F.ceil(counts / F.lit(RUN**level)) <= 1
        roots = add(roots, nodes.where(single).select("key", "digest"))
        if level == depth:
            break
        runs = cut(_runs(nodes.where(~single), "key", "n"))
        here = own.where(~single).select("pid", "key", F.expr(f"idx div {RUN}").alias("run"))
        want = cut((here if want is None else here.unionByName(want.select("pid", "key", F.expr(f"run div {RUN}").alias("run")))).distinct())
        needed = add(needed, want.join(runs, ["key", "run"]).select("pid", "key", F.lit(level).alias("level"), "run", "digests"))
        nodes = runs.select("key", "n", F.col("run").alias("idx"), _parent(F.col("digests")).alias("digest"))
    if needed is None:
        needed = boundary.limit(0).select("pid", "key", "level", F.col("idx").alias("run"), F.array("digest").alias("digests"))
    return cut(roots), cut(needed)


def top_tree(subroots: DataFrame) -> tuple[DataFrame, str | None]:
    """The tree over the subroots (``key``, ``digest``) in the order of their keys.

    Returns ``key``, ``subroot``, ``path`` (place and run, level by level) and
    the root, which is ``None`` without any rows.
    """
    ordered = range_sorted(subroots.withColumn("one", F.lit("")), ["one", "key"])
    ends = subroots.sparkSession.sparkContext.broadcast(partition_ends(ordered, "one"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if batch.num_rows:
                first = ends.value[batch.column(2)[0].as_py()][0] + done
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(range(first, first + batch.num_rows), pa.int64())], names=["key", "digest", "idx"])

    nodes = cut(ordered.select("key", "digest", "pid").mapInArrow(place, "key string, digest string, idx bigint"))
    n = nodes.count()
    steps = F.array().cast(PROOF.replace("siblings", "run"))
    paths = nodes.select("key", F.col("digest").alias("subroot"), F.col("idx").alias("up"), steps.alias("path"))
    for _ in sizes(n)[:-1]:
        runs = cut(_runs(nodes))
        step = F.struct((F.col("up") % RUN).cast("int").alias("at"), F.col("digests").alias("run"))
        paths = paths.join(runs.withColumnRenamed("run", "parent"), F.expr(f"up div {RUN}") == F.col("parent"))
        paths = cut(paths.select("key", "subroot", F.col("parent").alias("up"), F.concat("path", F.array(step)).alias("path")))
        nodes = runs.select(F.col("run").alias("idx"), _parent(F.col("digests")).alias("digest"))
    first = nodes.limit(1).select("digest").first()
    return paths.drop("up"), first and first[0]


def _walk(rows: list[tuple], given: list[tuple], ends: tuple[int, int, int], root: str, proofs: bool) -> Iterator[tuple]:
    """From each leaf of a partition to the root."""
    runs = {(key, level, run): digests for kind, key, level, run, digests, _, _ in given if kind == "run"}
    tops = {key: (subroot, [(s["at"], s["run"]) for s in path]) for kind, key, _, _, _, subroot, path in given if kind == "top"}
    for key, group, at, n in _held(rows, ends):
        counts, levels = sizes(n), local_levels([r[2] for r in group], at, n)
        subroot, top = tops[key]

        def run_of(level: int, run: int) -> list[str]:
            if level < len(levels):
                start, nodes = levels[level]
                if _whole(run, start, nodes, counts[level]):
                    return nodes[run * RUN - start : (run + 1) * RUN - start]
            return runs[key, level, run]

        above, steps, rest = None, [], ""
        for i, (_, id, leaf, tampered) in enumerate(group):
            place = at + i
            parent = place // RUN
            if parent != above and len(counts) > 1 or above is None:
                # the same for all leaves of a run: the steps from its parent to the root
                path = [(p % RUN, run_of(level, p // RUN)) for level in range(1, len(counts) - 1) for p in [place // RUN**level]] + top
                steps = [("".join(d[:k]), "".join(d[k + 1 :])) for k, d in path]
                rest, above = "".join(a + b for a, b in steps), parent
                own = run_of(0, parent) if len(counts) > 1 else None
            k = place % RUN
            first = [("".join(own[:k]), "".join(own[k + 1 :]))] if own else []
            folded = tampered or leaf
            for a, b in first + steps:
                folded = digest(a + folded + b)
            proof = digest("".join(a + b for a, b in first) + rest)
            line = (key, id, leaf, subroot, root, proof, folded, folded == root)
            if proofs:
                line += ([(j, d[:j] + d[j + 1 :]) for j, d in [(k, own)] * bool(own) + path],)
            yield line


def manifest(docs: DataFrame, proofs: bool = False, id: str = "doc_id", source: str = "source", others: tuple[str, ...] = ("lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf is the digest of id, source and the ``others``.  ``proof_sha256``
    is the digest of all siblings on the way to the root, one after the other;
    with ``proofs``, ``proof`` has them level by level, with the place ``at``
    of the node among them.  ``folded_root`` is worked out from the leaf, or
    where 5 divides the CRC-32 of the id from that of the row with A-Z of its
    text in lower case, and the siblings; ``verified`` says whether it is the root.

    Ids are longs; a null one comes first in its source and is never tampered
    with, null sources are a source and come first.  Rows of one id follow
    each other by their leaves; equal rows are leaves of their own, with one
    digest and proofs of their own places.  Texts of any length are read
    whole; other columns take no part, whatever their names; an empty table
    gives no rows.
    """
    fields = [F.col(id), F.col(source), *map(F.col, others)]
    changed = [F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == text else F.col(c) for c in (id, source, *others)]
    picked = F.pmod(F.crc32(F.col(id).cast("string")), F.lit(5)) == 0
    leaves = cut(docs.select(_source_key(F.col(source)).alias("key"), F.col(id).cast("bigint").alias("doc_id"), leaf_digest(*fields).alias("leaf"), F.when(picked, leaf_digest(*changed)).alias("tampered")))
    ordered = range_sorted(leaves, ["key", "doc_id", "leaf"])
    known = partition_ends(ordered, "key")
    context = docs.sparkSession.sparkContext
    ends = context.broadcast(known)
    boundary = boundary_nodes(ordered, ends)
    most = max((n for _, a, b in known.values() for n in (a, b)), default=0)
    roots, needed = finish_levels(boundary, max(1, boundary.agg(F.max("n")).first()[0] or 1, most))
    paths, root = top_tree(roots)

    # what the walks of a partition need besides its own leaves, sent to it by its number
    kind = lambda name: F.lit(name).alias("kind")
    runs = needed.select("pid", kind("run"), "key", "level", "run", "digests", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(PROOF.replace("siblings", "run")).alias("path"))
    there = ordered.select("pid", "key").distinct()
    tops = there.join(paths, "key").select("pid", kind("top"), "key", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("run"), F.lit(None).cast("array<string>").alias("digests"), "subroot", "path")
    leaves_of = ordered.select("key", "doc_id", "leaf", "tampered", "pid").rdd.mapPartitions(lambda it: [[tuple(r) for r in it]])
    sent = cut(runs.unionByName(tops)).rdd.map(lambda r: (r[0], tuple(r[1:]))).partitionBy(leaves_of.getNumPartitions(), lambda pid: pid).mapPartitions(lambda it: [[v for _, v in it]])

    def walk(pair: tuple[list, list]) -> Iterator[tuple]:
        rows, given = pair
        return _walk([r[:4] for r in rows], given, ends.value[rows[0][4]], root, proofs) if rows else iter(())

    schema = T.StructType.fromDDL(ROW + (f", proof {PROOF}" if proofs else ""))
    rows = docs.sparkSession.createDataFrame(leaves_of.zip(sent).flatMap(walk), schema, verifySchema=False)
    return rows.select("doc_id", F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), *[c for c in rows.columns if c not in ("doc_id", "key")])


def verify(leaf: str, proof: list[tuple[int, list[str]]], root: str) -> bool:
    """Whether a leaf belongs under a root, by its proof."""
    for at, siblings in proof:
        leaf = digest("".join(siblings[:at]) + leaf + "".join(siblings[at:]))
    return leaf == root


def manifest_sql(levels: int = 6) -> str:
    """DuckDB SQL for :func:`manifest` on ``documents``, for up to ``16 ** levels`` rows of a source and as many sources."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaves as (select doc_id, source, sha256({leaf("text")}) as leaf, sha256({leaf(lower)}) as lowered from documents)""",
        "placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from leaves)",
        "a0 as (select source as g, idx, leaf as h from placed)",
    ]

    def tree(name: str) -> None:
        """Level after level; a group with one node left passes it on."""
        for k in range(levels):
            parts.append(f"{name}r{k} as (select g, idx // 16 as run, list(h order by idx) as hs, any_value(n) as n from (select *, count(*) over (partition by g) as n from {name}{k}) group by g, idx // 16)")
            parts.append(f"{name}{k + 1} as (select g, run as idx, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}r{k})")

    def path(name: str, start: str) -> str:
        """From the nodes of a level to the top: the value folded so far, and the siblings met."""
        for k in range(levels):
            other = f"array_to_string(list_concat(hs[1:(p.idx % 16)::int], hs[(p.idx % 16)::int + 2:]), '')"
            fold = f"sha256(array_to_string(list_concat(list_concat(hs[1:(p.idx % 16)::int], [p.cur]), hs[(p.idx % 16)::int + 2:]), ''))"
            parts.append(f"{name}p{k} as (select p.key, p.g, p.idx // 16 as idx, case when n > 1 then {fold} else p.cur end as cur, case when n > 1 then p.proof || {other} else p.proof end as proof from {start} p join {name}r{k} r on r.g is not distinct from p.g and r.run = p.idx // 16)")
            start = f"{name}p{k}"
        return start

    tree("a")
    parts.append(f"subroots as (select g as source, h as subroot, row_number() over (order by g nulls first) - 1 as idx from a{levels})")
    parts.append("b0 as (select 0 as g, idx, subroot as h from subroots)")
    tree("b")
    parts.append("named as (select *, row_number() over () as key from placed)")
    # doc_id % 5 by its checksum can't be told from SQL without a function for it: each bit of the polynomial in turn
    parts.append(f"start as (select key, source as g, idx, case when {_crc_sql('doc_id')} % 5 = 0 then lowered else leaf end as cur, '' as proof from named)")
    inner = path("a", "start")
    parts.append(f"over as (select p.key, 0 as g, s.idx, p.cur, p.proof from {inner} p join subroots s on s.source is not distinct from p.g)")
    outer = path("b", "over")
    return f"""with {", ".join(parts)}
    select n.doc_id, n.leaf, s.subroot, (select h from b{levels}) as root, sha256(p.proof) as proof_sha256, p.cur as folded_root, p.cur = (select h from b{levels}) as verified
    from named n join {outer} p using (key) join subroots s on s.source is not distinct from n.source"""


def _crc_sql(column: str) -> str:
    """CRC-32 of a decimal number's digits as DuckDB SQL: bit after bit by a fold over a list."""
    polynomial = 0xEDB88320  # fixed value: the reversed polynomial
    step = "case when x & 1 = 1 then xor(x >> 1, {p}::bigint) else x >> 1 end".format(p=polynomial)
    bits = f"list_reduce(list_concat([xor(c, b)], range(8)), lambda x, _: {step})"
    bytes_ = f"list_concat([4294967295::bigint], list_transform(string_split({column}::varchar, ''), lambda ch: ascii(ch)::bigint))"
    return f"xor(list_reduce({bytes_}, lambda c, b: {bits}), 4294967295::bigint)"
