"""Full-text and similarity search over titles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.similarity import best_dice
from quillspark.operators.lineage import dealt
from quillspark.operators.paging import ranked_page

#: Keep a title that is no text hit from this score; what a text hit adds.
LEAST_SCORE, TEXT_BONUS = 0.30, 0.5
POOL = 2000
#: Constants of the BM25 rank.
K1, B = 1.2, 0.75


def _composed() -> dict[str, str]:
    """Composed lower-case letters whose canonical decomposition is one of a-z and combining marks, with that letter."""
    found = {}
    for c in map(chr, range(0x80, 0x3000)):
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and "a" <= first <= "z" and all(unicodedata.category(m).startswith("M") for m in marks):
            found[c] = first
    return found


_COMPOSED = _composed()


def plain(text: Column) -> Column:
    """Lower case without combining marks; composed Latin letters lose theirs.

    Texts of ASCII alone are only lower-cased.
    """
    low = F.lower(text)
    bare = F.regexp_replace(F.translate(low, "".join(_COMPOSED), "".join(_COMPOSED.values())), r"\p{M}", "")
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(bare)


def tokens(text: Column) -> Column:
    """Words of letters and digits, plain."""
    return F.filter(F.split(plain(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def query_tokens(query: str) -> list[str]:
    """Words of a query as :func:`tokens` has them: folded in the same way."""
    folded = query.lower().translate(str.maketrans(_COMPOSED))
    folded = "".join(c for c in folded if not unicodedata.category(c).startswith("M"))
    return "".join(c if c.isalpha() or unicodedata.category(c).startswith("N") else " " for c in folded).split()


def text_match(index: Column, query: str) -> Column:
    """All words of the query are tokens, the last one as a prefix; a blank query matches nothing."""
    words = query_tokens(query)
    if not words:
        return F.lit(False)
    hit = F.exists(index, lambda t: F.startswith(t, F.lit(words[-1])))
    for w in words[:-1]:
        hit = hit & F.array_contains(index, w)
    return hit


def phrase_match(index: Column, query: str) -> Column:
    """Every space-separated part of the query is a run of neighbouring tokens."""
    hit = F.lit(True)
    joined = F.concat(F.lit(" "), F.array_join(index, " "), F.lit(" "))
    for part in query.split():
        words = query_tokens(part)
        if words:
            hit = hit & F.contains(joined, F.lit(f" {' '.join(words)} "))
    return hit


def catalog_search(series: DataFrame, query: str, cleaned: str, descriptions: bool = False) -> DataFrame:
    """Text hits and similar titles with their score, in no order.

    ``series``: ``id``, ``title``, ``alternates``, ``description``, ``last_release_at``.
    The score is the best Dice score of the cleaned query, plus a bonus for a
    text hit; others are kept from the least score on.
    """
    titles = F.concat(F.array("title"), F.coalesce("alternates", F.array().cast("array<string>")))
    text = F.array_join(titles, " ")
    if descriptions:
        text = F.concat_ws(" ", text, F.col("description"))
    rows = series.select("id", "title", "last_release_at", text_match(tokens(text), query).alias("hit"), best_dice(F.lit(cleaned), titles).alias("dice"))
    rows = rows.where(F.col("hit") | (F.col("dice") >= F.lit(LEAST_SCORE).cast("float")))
    score = (F.col("dice") + F.when(F.col("hit"), F.lit(TEXT_BONUS)).otherwise(0.0)).cast("float")
    return rows.withColumn("score", score)


def search_page(found: DataFrame, series: DataFrame, page: int, size: int, allowed: DataFrame | None = None) -> DataFrame:
    """Page ``page`` (from 1) of what :func:`catalog_search` found: ``rank``, ``score``, ``total`` and the columns of ``series``.

    By score, then the last release (none last), then id.  With ``allowed``,
    only rows whose ``id`` is there count, in the ranks and in the total.  Only
    ids and sort keys are sorted; the columns of ``series`` are fetched for one page.
    """
    rows = found.select("id", "score", "last_release_at")
    rows = rows if allowed is None else rows.join(allowed.select("id").distinct(), "id", "left_semi")
    chosen = ranked_page(rows, [F.col("score").desc(), F.col("last_release_at").desc_nulls_last(), F.col("id")], page, size)
    return series.join(F.broadcast(chosen.select("id", "score", "rank", "total")), "id")


def relevance(titles: DataFrame, title: str, query: str, limit: int = POOL) -> DataFrame:
    """The ``limit`` rows that hold every part of a query as a phrase, by BM25, with their ``rank_score``.

    Greater scores first, then the id.  The table's size, its mean length and
    the rows that hold each part are one aggregation, joined as a single row.
    A query without words gives no rows.
    """
    parts = [" ".join(w) for w in map(query_tokens, query.split()) if w]
    if not parts:
        return titles.withColumn("rank_score", F.lit(0.0)).limit(0)
    rows = titles.withColumn("_tokens", tokens(F.col(title)))
    joined = F.concat(F.lit(" "), F.array_join("_tokens", "  "), F.lit(" "))
    times = [(F.size(F.split(joined, f" {'  '.join(p.split())} ")) - 1).alias(f"_f{i}") for i, p in enumerate(parts)]
    rows = rows.select("*", F.size("_tokens").alias("_length"), *times)
    every = rows.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(parts))])
    held = rows.where(" and ".join(f"_f{i} > 0" for i in range(len(parts)))).crossJoin(F.broadcast(every))
    score = F.lit(0.0)
    for i in range(len(parts)):
        rare = F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        times = F.col(f"_f{i}").cast("double")
        score = score + F.greatest(rare, F.lit(1e-6)) * times * (K1 + 1) / (times + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))
    return held.select(*titles.columns, score.alias("rank_score")).orderBy(F.col("rank_score").desc(), "id").limit(limit)


def fuzzy_candidates(titles: DataFrame, title: str, query: str, top: int, pool: int = POOL) -> DataFrame:
    """The ``top`` of the pool of :func:`relevance` by the Dice score of query and title, then the id."""
    held = relevance(titles, title, query, pool)
    scored = held.withColumn("dice", best_dice(F.lit(query), F.array(title)))
    return scored.orderBy(F.col("dice").desc(), "id").limit(top)


def token_index(titles: DataFrame, id: str, title: str) -> DataFrame:
    """Inverted index: ``token``, ``id``, one row each; ``id`` is a key of ``titles``, so no shuffle is needed."""
    return titles.select(F.explode(F.array_distinct(tokens(F.col(title)))).alias("token"), F.col(id).alias("id"))


def candidates(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id``, ``id``: entries that hold all tokens of a query (``query_id``, ``text``).

    The rarest token of a query is looked up first, the others verify, so a
    frequent token never multiplies rows.
    """
    # no side is broadcast: lists of words are far larger than the files that they are read from
    index = index.hint("merge")
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).hint("merge")
    need = words.groupBy("query_id").agg(F.count("*").alias("need"))
    sizes = index.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    counted = words.join(sizes, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = counted.groupBy("query_id").agg(F.min(F.struct("n", "token")).alias("r")).where("r.n > 0").select("query_id", F.col("r.token").alias("token"))
    first = rare.join(index, "token").select("query_id", "id")
    held = first.join(words, "query_id").join(index, ["token", "id"], "left_semi")
    return held.groupBy("query_id", "id").agg(F.count("*").alias("have")).join(need, "query_id").where("have = need").select("query_id", "id")


#: Members of a class that are gathered at once, about; members of a block.
STRIP, BLOCK = 4096, 64


def blocks(rows: DataFrame, id: str, kind: str, sizes: DataFrame) -> DataFrame:
    """The members of each class (column ``kind``) in blocks: ``kind``, ``_strip``, ``_<id>`` (at most :data:`BLOCK` sorted ids, a null one included).

    A class is dealt over strips of about :data:`STRIP` members.  ``sizes``:
    the classes with their number of strips, ``_strips``.
    """
    dealt_ = rows.join(sizes.hint("merge"), kind).withColumn("_strip", F.pmod(F.xxhash64(id), F.col("_strips")))
    strips = dealt_.groupBy(kind, "_strip").agg(F.array_sort(F.collect_list(F.struct(id))).getField(id).alias("_ids"))
    cuts = F.sequence(F.lit(1), F.size("_ids"), F.lit(BLOCK))
    return strips.select(kind, "_strip", "_ids", F.explode(cuts).alias("_at")).select(kind, "_strip", F.expr(f"slice(_ids, _at, {BLOCK})").alias(f"_{id}"))


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of classes (``left_class``, ``right_class``, ...) as pairs of their members, with the other columns of ``pairs``.

    ``left``: ``left_id``, ``left_class``; ``right``: ``right_id``,
    ``right_class``.  Blocks of members meet, not members: a left id stays for
    a block of right ids, and those come again at once for the next left id.
    The result is far larger than all that is shuffled here, and files of it
    take a small part of what they take where ids come again after thousands
    of others.  Strips of a class on the right are dealt by number, so that
    many copies are not one task's, nor too many ids for a file's dictionary.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = {side: rows.groupBy(f"{side}_class").agg(F.ceil(F.count("*") / STRIP).alias("_strips")) for side, rows in (("left", left), ("right", right))}
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_strips") - 1))
    wanted = pairs.join(sizes["right"].hint("merge"), "right_class").withColumn("_strip", each).drop("_strips")
    asked = blocks(left, left_id, "left_class", sizes["left"]).drop("_strip").join(wanted.hint("merge"), "left_class").drop("left_class")
    held = blocks(right, right_id, "right_class", sizes["right"])
    met = asked.repartition(parts, "right_class", "_strip").join(held.repartition(parts, "right_class", "_strip").hint("merge"), ["right_class", "_strip"])
    rest = [c for c in pairs.columns if c not in ("left_class", "right_class")]
    return met.select(F.explode(f"_{left_id}").alias(left_id), f"_{right_id}", *rest).select(left_id, F.explode(f"_{right_id}").alias(right_id), *rest)


def candidate_pairs(queries: DataFrame, titles: DataFrame, id: str, title: str) -> DataFrame:
    """The pairs of :func:`candidates`, where queries or titles have copies.

    Texts with the same set of words are one class, and only classes are
    looked up; the pairs of classes are written out for all members.
    """
    words = lambda c: F.array_join(F.array_sort(F.array_distinct(tokens(F.col(c)))), " ")
    asked = dealt(queries, "query_id").select("query_id", words("text").alias("left_class"))
    held = dealt(titles, id).select(F.col(id).alias("id"), words(title).alias("right_class"))
    classes = asked.select(F.col("left_class").alias("query_id"), F.col("left_class").alias("text")).distinct()
    index = token_index(held.select(F.col("right_class").alias("class")).distinct(), "class", "class")
    pairs = candidates(classes, index).select(F.col("query_id").alias("left_class"), F.col("id").alias("right_class"))
    return expanded(pairs, asked, held, "query_id", "id")
