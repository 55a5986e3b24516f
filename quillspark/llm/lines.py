"""Fuzzy line dedup: MinHash over character shingles, exact check, union-find.

Lines are compared lower-cased and trimmed.  Equal lines are one class; classes
meet under the keys of a MinHash signature and are linked if the exact Jaccard
similarity of their sets of eight-character shingles is 0.8 or more; one line
of each component stays, the first by document and line.

Signature: the 64-bit hashes of all distinct shingles of a line lie on a ring,
and for each of ten fixed points the four hashes that follow it are a band (the
four smallest under the permutation that turns the ring to that point).  Sets of
up to 16 hashes have a band for each of their hashes instead, which holds all
that the points could give.  So there is one scheme for all lengths: of two sets
with similarity 0.8 at least four in a row of all their hashes are shared, and a
small set can't miss; larger ones miss a pair right at 0.8 in less than one of
a hundred cases.

All of it is DataFrame functions.  A band key first links its members to the
one of them that meets most other lines; only keys that have several components
left among the others compare them with one another, so a key of thousands of
copies makes links in proportion to its members.  Characters outside the basic
plane count as two.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.graph import connected_components, cut, written

CHARS = 8
POINTS, WIDTH = 10, 4
#: Sets of up to so many hashes have a band for each hash.
SMALL = 16
SIMILARITY = 0.8
#: Words of a fine sketch; a power of two.
FINE = 16
#: Rounds after which keys are looked at again.
FIRST_ROUNDS = 2
#: Tables of up to so many bytes (numbers of rows and array entries times eight) are broadcast, larger ones joined by shuffle.
BROADCAST_BYTES = 32_000_000
_SPACES = " \t\r\x0b\x0c"
_PLACES = [-(2**63) + 987654321 + i * (2**64 // POINTS) for i in range(POINTS)]
_KEYS = [f"k{i}" for i in range(max(SMALL, POINTS))]


def _trimmed(line: Column) -> Column:
    """``line`` without the spaces at its ends; trimming a set of characters walks the line, so only where there is one."""
    ends = [end(line, F.lit(c)) for c in _SPACES for end in (F.startswith, F.endswith)]
    return F.when(reduce(or_, ends), F.trim(line, F.lit(_SPACES))).otherwise(line)


def normal_line(line: Column) -> Column:
    return F.lower(_trimmed(line))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apart(column: Column) -> Column:
    """The same value by a lambda.

    A projection that holds a lambda is compiled as many small methods; within
    a whole stage all keys would be one method, too large for the JIT.
    """
    return _let(column, lambda x: x)


def shingle_hashes(line: Column) -> Column:
    """64-bit hashes of the eight-character shingles of a normalised line, repeats included; a shorter line is one shingle.

    Two bytes a character, so that a shingle is found without walking the line.
    """
    starts = lambda x: F.sequence(F.lit(1), F.greatest(F.octet_length(x) - (2 * CHARS - 1), F.lit(1)), F.lit(2))
    return _let(F.encode(line, "UTF-16BE"), lambda x: F.transform(starts(x), lambda i: F.xxhash64(F.substring(x, i, F.lit(2 * CHARS)))))


def with_keys(lines: DataFrame) -> DataFrame:
    """``lines`` with ``k0``, ``k1``, ... in place of ``line`` (normalised): the band keys, null where a line has fewer."""
    kept = [c for c in lines.columns if c != "line"]
    rows = lines.select(*kept, F.sort_array(shingle_hashes(F.col("line"))).alias("all"))
    # few hashes, or few without repeats: all of them once
    rows = rows.select(*kept, F.when(F.size("all") <= 4 * SMALL, F.array_distinct("all")).otherwise(F.col("all")).alias("ring"))
    marked = F.sort_array(F.concat("ring", F.array(*[F.lit(p) for p in _PLACES])))
    rows = rows.select(*kept, "ring", marked.alias("marked"), F.concat("ring", F.slice("ring", 1, 12)).alias("round"))
    small = F.size("ring") <= SMALL
    starts = []
    for i in range(len(_KEYS)):
        point = (F.array_position("marked", F.lit(_PLACES[i])) - i).cast("int") if i < POINTS else F.lit(None).cast("int")
        starts.append(F.when(small, F.when(F.size("ring") > i, F.lit(i + 1))).otherwise(point).alias(f"s{i}"))
    rows = rows.select(*kept, "ring", "round", *starts)
    return rows.select(*[_apart(F.col(c)).alias(c) if n == 0 else F.col(c) for n, c in enumerate(kept)], *[_band(F.col(f"s{i}")).alias(k) for i, k in enumerate(_KEYS)])


def _band(start: Column) -> Column:
    """Hash of the first four distinct hashes of ``ring`` from a place on.

    Repeats stand side by side, and are rare: more is looked at only where there are any.
    """
    four = [F.get("round", start + (k - 1)) for k in range(WIDTH)]
    apart = (four[0] != four[1]) & (four[1] != four[2]) & (four[2] != four[3])
    twelve = F.array_distinct(F.slice("round", start, F.lit(3 * WIDTH)))
    whole = F.array_distinct(F.concat(F.slice("ring", start, F.size("ring")), F.col("ring")))
    # the hash of an array is that of its elements
    band = (
        F.when(apart & (F.size("ring") >= WIDTH), F.xxhash64(*four))
        .when(F.size(twelve) >= WIDTH, F.xxhash64(F.slice(twelve, 1, WIDTH)))
        .otherwise(F.xxhash64(F.slice(whole, 1, WIDTH)))
    )
    return F.when(start.isNotNull(), band)


def _small(df: DataFrame, entries: Column | None = None) -> bool:
    """Whether a table's columns, and the entries of an array, stay below the bound of a broadcast."""
    row = F.lit(8 * len(df.columns)) if entries is None else 8 * (len(df.columns) + entries)
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0] <= BROADCAST_BYTES


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``said`` (hash of the text), ``pos``, ``line`` (normalised) of all lines that are not blank."""
    cut_up = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("said"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    filled = cut_up.where(_trimmed(F.col("raw")) != "")
    return filled.select("id", "said", "pos", normal_line(F.col("raw")).alias("line"))


def fine_sketches(texts: DataFrame) -> DataFrame:
    """``h``, ``sketch`` of each row (``h``, ``line``): the size of its shingle set and sixteen words of 64 bits.

    A bit says whether an odd number of the set's hashes falls on its place.
    """
    rows = texts.select("h", F.explode(F.array_distinct(shingle_hashes(F.col("line")))).alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(FINE - 1))
    words = [F.coalesce(F.bit_xor(F.when(word == w, bit)), F.lit(0).cast("bigint")).alias(f"p{w}") for w in range(FINE)]
    made = rows.groupBy("h").agg(F.count("*").alias("n"), *words)
    return made.select("h", F.struct("n", *[f"p{w}" for w in range(FINE)]).alias("sketch"))


def may_be_similar(a: str, b: str, words: int = FINE) -> Column:
    """False only for sketches of sets that are surely not similar.

    Sets that differ in d shingles differ in at most d parities, and similar
    ones differ in at most (1 - s) / (1 + s) of the sum of their sizes.
    """
    differs = sum((F.bit_count(F.col(f"{a}.p{q}").bitwiseXOR(F.col(f"{b}.p{q}"))) for q in range(words)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9) & (differs <= (n + m) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9)


def similarity(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two arrays of shingle hashes."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose lines are similar, by the sets of their shingles' 64-bit hashes.

    Many pairs may have the same ``b``, so ``a`` is joined last: the sets are
    built in the tasks that the pairs are dealt to by ``a``.  These are few
    bytes with much work, so their number is fixed, not fitted to the bytes.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b").repartition(parts, "a")
    rows = rows.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a")
    sets = rows.select("a", "b", shingle_hashes(F.col("line_a")).alias("x"), shingle_hashes(F.col("line_b")).alias("y"))
    # settled before the filter, which would otherwise be moved below and build the sets twice
    compared = cut(sets.select("a", "b", similarity(F.col("x"), F.col("y")).alias("similarity")))
    return compared.where(F.col("similarity") >= SIMILARITY - 1e-9).select("a", "b")


def _links(lines: DataFrame, again: DataFrame) -> DataFrame:
    """Component (``node``, ``component``) of each class ``h`` that is similar to another one.

    ``lines`` has ``h`` and the keys of all lines, ``again`` gives ``h``, ``line``.
    """
    # repeated lines are one class before the keys are dealt out
    keyed = lines.groupBy("h").agg(*[F.min(k).alias(k) for k in _KEYS])
    postings = keyed.select("h", F.explode(F.array_distinct(F.array(*_KEYS))).alias("key")).where("key is not null")
    # one shuffle of the postings: a key's members are counted where they lie
    shared = cut(postings.select("key", "h", F.count("*").over(Window.partitionBy("key")).alias("n")).where("n > 1"))

    met = cut(shared.groupBy("h").agg(F.sum("n").alias("weight")))
    chosen = met.select("h")
    texts = again.join(F.broadcast(chosen) if _small(chosen) else chosen, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = cut(texts)

    # the member that meets most others leads: in a group of edited copies, the text they were made from
    leads = shared.join(met, "h").groupBy("key").agg(F.max(F.struct("weight", "h")).alias("top"))
    led = cut(shared.join(leads, "key").where(F.col("h") != F.col("top.h")).select("key", "h", F.col("top.h").alias("lead"), "n"))
    star = led.select(F.col("h").alias("a"), F.col("lead").alias("b")).distinct()
    label = cut(connected_components(_verified(star, texts), enough=FIRST_ROUNDS))
    # all pairs with a leader are settled; left are pairs of other members that are not in one component yet
    member = led.where("n > 2").select("key", "h").join(label.withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("component", "h").alias("label"))
    mixed = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    # finer sketches are compared within the join, so only pairs that may be similar leave it
    member = cut(member.join(mixed, "key"))
    fine = fine_sketches(texts.join(member.select("h").distinct(), "h", "left_semi"))
    left = cut(member.join(fine, "h"))
    right = left.select(F.col("key").alias("key2"), F.col("h").alias("h2"), F.col("label").alias("label2"), F.col("sketch").alias("sketch2"))
    meets = (F.col("key") == F.col("key2")) & (F.col("label") < F.col("label2")) & may_be_similar("sketch", "sketch2")
    across = left.join(right, meets).select(F.col("h").alias("a"), F.col("h2").alias("b")).distinct()
    links = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_verified(across, texts))
    return connected_components(links)


def line_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``said`` (hash of the text), ``pos``, ``h`` (class of the line), ``keeper`` of every line that has a copy.

    Lines are numbered from 0 within ``text.split('\\n')``.  ``keeper`` is true
    for the one line of a component that stays, the first by (id, pos, hash of
    the text).  Ids may be of any type that has an order.  Blank lines and null
    texts have no copies; rows with a null id are not looked at; empty tables
    give no rows; a line of any length is one line.  A class is named by a
    64-bit hash; lines whose second hash (32 bits) differs from that of the
    class are left alone, so none goes for a chance meeting of hashes.
    """
    docs = docs.where(F.col(id).isNotNull())
    found = _lines(docs, id, text).select("id", "said", "pos", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    lines = written(with_keys(found), ["h", "g", *_KEYS])
    again = _lines(docs, id, text).select(F.xxhash64("line").alias("h"), "line")
    label = cut(_links(lines.select("h", *_KEYS), again))

    # classes with a copy: more than one line, or in a component with another class
    at = F.struct("id", "pos", "said")
    if isinstance(docs.schema[id].dataType, T.IntegralType):  # the same order as one number
        place = (F.col("id").cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("pos")).cast("decimal(29,0)")
        at = (place * F.lit(2**32).cast("decimal(10,0)") + F.col("said").bitwiseAND(F.lit(2**32 - 1))).cast("decimal(38,0)")
    lines = lines.select("id", "said", "pos", "h", "g")
    classes = lines.groupBy("h").agg(F.min(at).alias("at"), F.min("g").alias("g"), F.count("*").alias("n"))
    named = classes.join(label.withColumnRenamed("node", "h"), "h", "left")
    named = named.where("n > 1 or component is not null").select("h", "g", "at", F.coalesce("component", "h").alias("component"))
    first = named.groupBy("component").agg(F.min("at").alias("first"))
    copied = cut(named.join(first, "component").select("h", "g", "first"))
    rows = lines.join(F.broadcast(copied) if _small(copied) else copied, ["h", "g"])
    return rows.select("id", "said", "pos", "h", (at == F.col("first")).alias("keeper"))


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``said`` and ``gone``, the sorted numbers of the lines that go, of each document that loses any."""
    found = line_components(docs, id, text).where(~F.col("keeper"))
    return found.groupBy("id", "said").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines numbered in ``gone``; unchanged where that is null."""
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def _deduped(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with ``lost`` (numbers of its lines that go, or null) and ``kept`` (its text without them)."""
    lost = cut(dropped_lines(docs, id, text)).withColumnRenamed("gone", "lost")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("said"))
    small = _small(lost, F.size("lost"))
    joined = rows.join(F.broadcast(lost) if small else lost, ["id", "said"], "left")
    return joined.select("row", "lost", without_lines(F.col("row").getField(text), F.col("lost")).alias("kept"))


def _unpacked(rows: DataFrame, names: list[str], text: str) -> list[Column]:
    return [F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``gone``, with the copied lines taken out of ``text``.

    ``gone`` is null for documents that lose nothing, and replaces a column of
    that name.  Rows with the same id and the same text are one document;
    those with other texts are other documents.
    """
    rows = _deduped(docs, id, text)
    return rows.select(*_unpacked(rows, [c for c in docs.columns if c != "gone"], text), F.col("lost").alias("gone"))


def dedup_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without copied lines; documents that lose all that is not blank go, too.  All columns stay, whatever their names."""
    rows = _deduped(docs, id, text)
    emptied = F.col("lost").isNotNull() & (F.trim(F.col("kept"), F.lit(" \t\r\n\x0b\x0c")) == "")
    return rows.where(~emptied).select(*_unpacked(rows, docs.columns, text))
