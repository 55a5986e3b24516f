"""Join shapes of the catalog: semi, anti, division, priority, decoration, fuzzy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.similarity import bigrams, dice_of, folded
from quillspark.operators.search import expanded


def carried_by(releases: DataFrame, bridge: DataFrame, sources: list[str]) -> DataFrame:
    """Releases that any of the sources carries, through the bridge table."""
    keys = bridge.where(F.col("source_name").isin(sources)).select(F.col("release_id").alias("id"))
    return releases.join(keys, "id", "left_semi")


def with_any(entities: DataFrame, links: DataFrame, id: str, name: str, names: list[str]) -> DataFrame:
    """Entities linked to at least one of the names."""
    return entities.join(links.where(F.col(name).isin(names)).select(id), id, "left_semi")


def with_all(entities: DataFrame, links: DataFrame, id: str, name: str, names: list[str]) -> DataFrame:
    """Relational division: entities linked to all names.

    As many distinct names must be found as were asked for, so a name that is
    asked for twice matches nothing.
    """
    found = links.where(F.col(name).isin(names)).groupBy(id).agg(F.count_distinct(name).alias("n")).where(F.col("n") == len(names))
    return entities.join(found.select(id), id, "left_semi")


def without(entities: DataFrame, others: DataFrame, id: str, other_id: str) -> DataFrame:
    """Entities that no row of ``others`` refers to; null references refer to nothing."""
    return entities.join(others.where(F.col(other_id).isNotNull()).select(F.col(other_id).alias(id)), id, "left_anti")


def orphans(series: DataFrame, releases: DataFrame, candidates: DataFrame, library: DataFrame, keep_wishlisted: bool = True) -> DataFrame:
    """Series nothing refers to, that are not owned (nor wished for)."""
    alone = without(without(without(series, releases, "id", "series_id"), candidates, "id", "series_id"), library, "id", "series_id")
    alone = alone.where(~F.col("owned"))
    return alone.where(F.col("wishlisted_at").isNull()) if keep_wishlisted else alone


def first_match(keyed: DataFrame, mapping: DataFrame, row: str, position: str, on: list[str]) -> DataFrame:
    """For each row the match of its first key that has one: lowest position, then lowest target.

    One aggregation after the join, with partial results on the map side.
    """
    value = [c for c in mapping.columns if c not in on]
    hits = keyed.join(mapping, on)
    best = hits.groupBy(row).agg(F.min(F.struct(position, *value, *on)).alias("best"))
    return best.select(row, "best.*")


def unpivot_ids(dump: DataFrame, id: str, columns: dict[str, str], state: str | None = None) -> DataFrame:
    """``provider``, ``external_id``, ``id``: one row for each id that a wide row holds.

    Of rows that share an id, active ones come first, then the smallest; only
    the winner is returned, and only if it is active.
    """
    pairs = F.array(*[F.struct(F.lit(p).alias("provider"), F.col(c).cast("string").alias("external_id")) for p, c in columns.items()])
    active = F.coalesce(F.col(state) == "active", F.lit(True)) if state else F.lit(True)
    rows = dump.select(F.col(id).alias("id"), active.alias("active"), F.explode(pairs).alias("p")).where("p.external_id is not null")
    best = rows.groupBy("p.provider", "p.external_id").agg(F.min(F.struct((~F.col("active")).alias("gone"), "id")).alias("best"))
    return best.where("not best.gone").select("provider", "external_id", F.col("best.id").alias("id"))


def decorated(page: DataFrame, bridge: DataFrame, id: str, value: str, name: str) -> DataFrame:
    """A page with the sorted values of a bridge table as one array column; empty where there are none."""
    lists = bridge.groupBy(id).agg(F.array_sort(F.collect_set(value)).alias(name))
    kind = dict(lists.dtypes)[name]
    return page.join(lists, id, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def latest_item(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sweep of an external index: each item goes to its first id that maps; of items for one series the last stays.

    ``items``: ``place``, ``item``, ``ids`` (array of provider, external_id).
    """
    keyed = items.select("place", "item", F.posexplode("ids").alias("pos", "k")).select("place", "item", "pos", "k.provider", "k.external_id")
    hit = first_match(keyed, mapping.select("provider", "external_id", "series_id"), "place", "pos", ["provider", "external_id"])
    named = hit.join(items.select("place", "item"), "place")
    best = named.groupBy("series_id").agg(F.max(F.struct("place", "item", "provider", "external_id")).alias("b"))
    return best.select("series_id", "b.item", "b.provider", "b.external_id")


def title_classes(rows: DataFrame, id: str = "id", title: str = "title") -> DataFrame:
    """Titles that fold to the same letters and digits as one class: ``id`` (the smallest), ``title`` (folded), ``n`` (members)."""
    return rows.groupBy(folded(F.coalesce(F.col(title), F.lit(""))).alias("title")).agg(F.min(id).alias("id"), F.count("*").alias("n"))


def title_members(rows: DataFrame, id: str = "id", title: str = "title") -> DataFrame:
    """``id``, ``class_id``: the class of :func:`title_classes` of each row."""
    named = rows.select(F.col(id).alias("id"), folded(F.coalesce(F.col(title), F.lit(""))).alias("title"))
    return named.join(title_classes(rows, id, title).select("title", F.col("id").alias("class_id")), "title").select("id", "class_id")


def similar_title_classes(left: DataFrame, right: DataFrame, threshold: float, id: str = "id", title: str = "title") -> DataFrame:
    """Pairs of classes of titles with a Dice score at or above ``threshold``: ``left_id``, ``right_id``, ``left_n``, ``right_n``, ``score``.

    Copies are one class on either side before anything is compared, so the
    work and the result don't grow with them.
    """
    a, b = title_classes(left, id, title), title_classes(right, id, title)
    pairs = similar_titles(a, b, threshold)
    return pairs.join(a.select(F.col("id").alias("left_id"), F.col("n").alias("left_n")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("n").alias("right_n")), "right_id")


def similar_title_rows(left: DataFrame, right: DataFrame, threshold: float, id: str = "id", title: str = "title", digits: int | None = None) -> DataFrame:
    """``left_id``, ``right_id``, ``score``: all pairs of rows, copies included, whose titles have a Dice score at or above ``threshold``.

    Classes of equal titles are compared, and their pairs written out for all members.
    With ``digits`` the scores are doubles, rounded to as many places: once a pair of classes, not once a row.
    """
    sides = [title_members(df, id, title) for df in (left, right)]
    score = F.col("score") if digits is None else F.round(F.col("score").cast("double"), digits)
    pairs = similar_title_classes(left, right, threshold, id, title).select(F.col("left_id").alias("left_class"), F.col("right_id").alias("right_class"), score.alias("score"))
    members = [rows.select(F.col("id").alias(f"{side}_id"), F.col("class_id").alias(f"{side}_class")) for side, rows in zip(("left", "right"), sides)]
    return expanded(pairs, *members, "left_id", "right_id").select("left_id", "right_id", "score")


def similar_titles(left: DataFrame, right: DataFrame, threshold: float, left_id: str = "id", right_id: str = "id", title: str = "title") -> DataFrame:
    """All pairs of titles with a Dice score at or above ``threshold`` (above 0), without a cross join.

    Prefix filtering: bigrams are ordered by rarity; two sets whose score is t
    or more share one of the first n - ceil(n t / (2 - t)) + 1 bigrams of
    each.  The index holds only those, as ids with the set's size and the
    bigram's place; sizes too far apart and places that leave too few bigrams
    to share are refused within the join.  Sets are fetched for the pairs that
    are left, and each is verified.  Titles without bigrams score 1.0 against
    each other and are paired by that class.  Ids are keys of their table.
    """
    sides = []
    for side, df, id in (("left", left, left_id), ("right", right, right_id)):
        sides.append(df.select(F.lit(side).alias("side"), F.col(id).alias("id"), bigrams(F.coalesce(F.col(title), F.lit(""))).alias("grams")))
    grams = sides[0].unionByName(sides[1])
    listed = grams.select("side", "id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    seen = listed.groupBy("gram").agg(F.count("*").alias("c"))
    rare = listed.join(seen, "gram").groupBy("side", "id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("by_rarity"))
    t = float(threshold)
    keep = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(t / (2 - t)) - 1e-9) + 1, F.lit(1)).cast("int")
    prefix = rare.select("side", "id", "n", F.posexplode(F.slice("by_rarity", F.lit(1), keep)).alias("at", "r")).select("side", "id", "n", "at", F.col("r.gram").alias("gram"))
    a, b = (prefix.where(F.col("side") == x).select("gram", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "at")]) for x in ("left", "right"))
    shared = F.least(F.col("left_n") - F.col("left_at"), F.col("right_n") - F.col("right_at"))
    enough = 2 * shared >= F.lit(t) * (F.col("left_n") + F.col("right_n")) - 1e-6
    near = F.least("left_n", "right_n") >= F.lit(t / (2 - t)) * F.greatest("left_n", "right_n") - 1e-6
    met = a.join(b, "gram").where(near & enough).select("left_id", "right_id").distinct()
    pairs = met.join(sides[0].select(F.col("id").alias("left_id"), F.col("grams").alias("left_grams")), "left_id").join(sides[1].select(F.col("id").alias("right_id"), F.col("grams").alias("right_grams")), "right_id")
    found = pairs.select("left_id", "right_id", dice_of(F.col("left_grams"), F.col("right_grams")).alias("score")).where(F.col("score") >= F.lit(threshold).cast("float"))
    bare = grams.where(F.size("grams") == 0).select("side", "id", F.lit("").alias("gram"))
    empty = bare.where("side = 'left'").select("gram", F.col("id").alias("left_id")).join(bare.where("side = 'right'").select("gram", F.col("id").alias("right_id")), "gram")
    return found.unionByName(empty.select("left_id", "right_id", F.lit(1.0).cast("float").alias("score")))
