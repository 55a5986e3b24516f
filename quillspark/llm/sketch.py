"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's word shingles, sorted.
Sketches of parts merge into the sketch of the whole, and estimate the
resemblance and containment of two texts and the number of distinct shingles;
while a text has at most k distinct shingles they are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.graph import cut

K = 256
SHINGLE = 5
#: Hashes are cut to this many bits, ten hexadecimal digits in a fingerprint.
BITS = 40
#: Documents of so many consecutive ids make a window; the place of a window's successor
#: is broadcast while the number of windows stays below the bound, else joined by shuffle.
WINDOW_BITS = 10
BROADCAST_WINDOWS = 1_000_000
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of the word shingles of a lower-cased text, with repeats.

    Words are runs without ASCII white space.  Fewer than ``width`` words make
    one shingle, no words (or null) none.
    """
    trimmed = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))

    def hashed(words: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
        mask = F.lit((1 << BITS) - 1)
        shingles = F.transform(first, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]).bitwiseAND(mask))
        return F.when(F.get(words, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(shingles)

    return _let(F.split(trimmed, _SPACE), hashed)


def bottom_k(hashes: Column, k: int = K) -> Column:
    """Sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return bottom_k(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike (1), an empty one and another not (0)."""
    both = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return _let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    estimate = (F.lit(k) - 1) * F.lit(float(1 << BITS)) / F.element_at(a, -1)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(estimate)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    union = distinct_shingles(merged(a, b, k), k)
    shared = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """Sketch as text: ten hexadecimal digits a hash, ascending."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def sketch_groups(docs: DataFrame, by: list[str], text: str = "text", k: int = K) -> DataFrame:
    """``by`` and the ``sketch`` of all texts of each group, merged.

    Hashes are cut to a document's k before the shuffle and made distinct per
    group on the map side; the rank limit holds on the map side, too, so a
    group with a third of all rows sends k rows a task.
    """
    own = docs.select(*by, F.explode(bottom_k(shingle_hashes(F.col(text)), k)).alias("h")).distinct()
    order = Window.partitionBy(*by).orderBy("h")
    low = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def _window(key: Column, bits: int) -> Column:
    """Number (0 or more) of the group of ``2**bits`` neighbouring values that a long key falls in; ascending with the key."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), bits)


def following(keys: DataFrame, bits: int = WINDOW_BITS) -> DataFrame:
    """``key`` and the next greater key (``next``; null for the last) of distinct long keys of any sign.

    Keys are ordered within groups of ``2**bits`` neighbouring values; a
    group's last key is followed by the first of the next group, found in the
    same way among the groups.  No step sorts all keys in one task, and each
    level has keys of ``bits`` bits less, so there are seven levels at most.
    """
    ends = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    group = _window(F.col("key"), bits)
    inner = Window.partitionBy("g").orderBy("key")
    near = keys.withColumn("g", group).withColumn("next", F.lead("key").over(inner))
    if ends["lo"] is None or (ends["lo"] + 2**63) >> bits == (ends["hi"] + 2**63) >> bits:
        return near.select("key", "next")
    firsts = cut(keys.groupBy(group.alias("g")).agg(F.min("key").alias("first")))
    after = following(firsts.select(F.col("g").alias("key")), bits)
    jump = after.join(firsts, F.col("next") == F.col("g")).select(F.col("key").alias("g"), "first")
    return near.join(jump, "g", "left").select("key", F.coalesce("next", "first").alias("next"))


def with_next(docs: DataFrame, id: str, carry: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each column of ``carry``: its value in the next row by ``id``.

    Ascending id (a whole number within the longs; a text that is none is an
    error), null first, ties by the carried columns; the last row is followed
    by the first.  Rows are dealt to windows of neighbouring ids, and
    the first row of each window is also dealt to the window before, so each
    row moves once and no window is longer than its ids.  Rows without an id
    are a window of their own, before all others.
    """
    number = F.col(id).cast("bigint")
    place = F.when(number.isNull(), 0).otherwise(_window(number, WINDOW_BITS) + 1)
    docs = docs.withColumn("_id", F.coalesce(number, F.lit(0).cast("bigint"))).withColumn("_window", place.cast("bigint"))
    firsts = docs.groupBy("_window").agg(F.min("_id").alias("first"))
    firsts = cut(firsts)
    order = cut(following(firsts.select(F.col("_window").alias("key"))))
    lowest = firsts.agg(F.min("_window")).first()[0]
    after = order.select(F.col("key").alias("before"), F.coalesce("next", F.lit(lowest)).alias("_window"))
    heads = after.join(firsts, "_window").select("_window", F.col("first").alias("_id"), "before")
    small = heads.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    rows = docs.join(F.broadcast(heads) if small else heads, ["_window", "_id"], "left")
    both = F.when(F.col("before").isNull(), F.array(F.struct(F.col("_window").alias("w"), F.lit(0).alias("lent"))))
    both = both.otherwise(F.array(F.struct(F.col("_window").alias("w"), F.lit(0).alias("lent")), F.struct(F.col("before").alias("w"), F.lit(1).alias("lent"))))
    dealt = rows.withColumn("_to", F.explode(both)).withColumn("_w", F.col("_to.w")).withColumn("_lent", F.col("_to.lent"))
    order = Window.partitionBy("_w").orderBy("_lent", "_id", *carry)
    for c in carry:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where("_lent = 0").drop("_id", "_window", "_to", "_w", "_lent", "before")


def fingerprint_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text and of its edited text, and their likeness.

    The edited text is the text whose last floor(n/2) code points are replaced
    by the first as many, or all, of the next document's text.  Null texts are
    empty.  Of rows with one id, equal or not, each is the next of the other.
    Returns ``id``, ``n_chars``, ``edited`` (text), ``sketch``,
    ``edited_sketch``, ``next_sketch``.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", bottom_k(shingle_hashes(F.col("text")), k))
    rows = with_next(rows, "id", ["text", "sketch"])
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select(F.col("id").alias(id), F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return rows.withColumn("edited_sketch", bottom_k(shingle_hashes(F.col("edited")), k))
