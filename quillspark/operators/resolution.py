"""Entity resolution of releases: known ids, foreign ids, similar titles, rules, review.

Each step is a join over all releases that are still open; decisions are
columns; tables that several steps read are settled once.  The outcome table has one row a release; candidates for review are a
table of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import formats as fm
from quillspark.functions.similarity import dice
from quillspark.functions.titles import clean_title
from quillspark.functions.values import reason
from quillspark.operators import entities
from quillspark.operators.lineage import dealt, settled
from quillspark.operators.joins import first_match
from quillspark.operators.paging import top_per_group
from quillspark.operators.search import candidates, token_index

ACCEPT, REVIEW, REVIEW_ROWS, HITS = 0.85, 0.55, 5, 10


def open_releases(releases: DataFrame, statuses: list[str] | None = None, forced: bool = False) -> DataFrame:
    """Releases to resolve: of the statuses, without those that an operator decided unless forced."""
    rows = releases if statuses is None else releases.where(F.col("resolution_status").isin(statuses))
    if forced:
        return rows
    decided = F.col("resolution_status").isin("rejected", "standalone") | F.col("resolution_path").eqNullSafe("manual")
    return rows.where(~decided)


def features(releases: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Formats (with title hints) and cleaned queries."""
    kinds = F.concat(fm.detect_formats(F.col("files")), fm.title_hints(F.col("title")))
    return releases.withColumn("formats", kinds).withColumn("cleaned", clean_title(F.col("title"), words))


def normalised_links(releases: DataFrame, id_map: DataFrame) -> DataFrame:
    """``id``, ``pos``, ``provider``, ``external_id`` of each link, the information page's first.

    Legacy ids are translated by ``id_map`` (``legacy_id``, ``modern_id``; null
    is a tombstone): dead and unknown ones go.  Repeated pairs count once.
    ``releases`` has ``links``, an array of provider, id.
    """
    pairs = releases.select("id", F.posexplode("links").alias("pos", "l")).select("id", "pos", "l.provider", F.col("l.id").alias("external_id"))
    legacy = pairs.where("provider = 'mangaupdates-legacy'").join(id_map.select(F.col("legacy_id").cast("string").alias("external_id"), "modern_id"), "external_id").where("modern_id is not null")
    modern = legacy.select("id", "pos", F.lit("mangaupdates").alias("provider"), F.col("modern_id").alias("external_id"))
    every = pairs.where("provider <> 'mangaupdates-legacy'").unionByName(modern)
    return every.groupBy("id", "provider", "external_id").agg(F.min("pos").alias("pos"))


def fuzzy_hits(releases: DataFrame, catalog: DataFrame, limit: int = HITS) -> DataFrame:
    """``id``, ``entry``, ``title``, ``kind``, ``score``: the best entries of each release.

    Entries that hold all words of a cleaned query are scored by weight times
    Dice of the canonical title; an entry's score is its best over the
    queries; ties go to the smaller entry.  Equal queries are looked up once.
    """
    queries = releases.select("id", F.explode("cleaned.queries").alias("q")).select("id", "q.text", "q.weight")
    texts = queries.select("text").distinct()
    index = token_index(catalog, "entry", "title")
    found = candidates(texts.select(F.col("text").alias("query_id"), "text"), index)
    rows = found.select(F.col("query_id").alias("text"), F.col("id").alias("entry")).join(catalog.select("entry", "title").hint("merge"), "entry")
    alike = rows.select("text", "entry", dice(F.col("text"), F.col("title")).alias("dice"))
    # the best of a release are among the best of its queries, so each different query is ranked once
    weighted = alike.join(queries.select("text", "weight").distinct().hint("merge"), "text")
    scored = weighted.select("text", "weight", "entry", (F.col("weight") * F.col("dice")).cast("float").alias("score"))
    per_query = top_per_group(scored, ["text", "weight"], limit, F.col("score").desc(), F.col("entry")).drop("rank")
    best = queries.join(per_query.hint("merge"), ["text", "weight"]).groupBy("id", "entry").agg(F.max("score").alias("score"))
    top = top_per_group(best, ["id"], limit, F.col("score").desc(), F.col("entry"))
    return top.join(catalog.select("entry", "title", "kind").hint("merge"), "entry")


def resolve(releases: DataFrame, mapping: DataFrame, foreign: DataFrame, catalog: DataFrame, id_map: DataFrame, rules=fm.RULES, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcomes (``id``, ``path``, ``status``, ``entry``, ``series_id``, ``confidence``) and review candidates.

    ``mapping``: known ids of series (``provider``, ``external_id``, ``series_id``,
    ``kind``); ``foreign``: ids that catalog entries hold (``provider``,
    ``external_id``, ``entry``); ``catalog``: ``entry``, ``title``, ``kind``.
    Steps in order, each on what the steps before left open; see the module.
    With ``records`` (``entry``), a title match whose entry has no record is
    not accepted: the release is put up for review like one without a strong
    match, with those entries that have one.
    """
    # tables of ids and titles are larger than their files tell: none is sent through the driver
    mapping, foreign, catalog, id_map = (df.hint("merge") for df in (mapping, foreign, dealt(catalog, "entry"), id_map))
    rows = settled(features(dealt(releases, "id")))
    links = normalised_links(releases, id_map)
    known = first_match(links, mapping.select("provider", "external_id", "series_id"), "id", "pos", ["provider", "external_id"]).select("id", F.col("series_id").alias("known"))
    entry = first_match(links, foreign, "id", "pos", ["provider", "external_id"]).select("id", F.col("entry").alias("looked_up"))
    kinds = mapping.groupBy("series_id").agg(F.first("kind").alias("known_kind"))
    staged = rows.select("id", "formats", "cleaned").join(known.hint("merge"), "id", "left").join(entry.hint("merge"), "id", "left")
    staged = staged.join(kinds.hint("merge"), F.col("known") == F.col("series_id"), "left").drop("series_id")
    staged = staged.join(catalog.select(F.col("entry").alias("looked_up"), F.col("kind").alias("entry_kind")), "looked_up", "left")

    staged = settled(staged)
    by_id = staged.where("known is not null")
    by_foreign = staged.where("known is null and looked_up is not null")
    left = staged.where("known is null and looked_up is null")
    hits = fuzzy_hits(left.select("id", "cleaned"), catalog).join(left.select("id", "formats").hint("merge"), "id")
    hits = hits.withColumn("fits", fm.compatible(F.col("formats"), F.col("kind"), rules)).withColumn("buckets", fm.kind_buckets(F.col("formats"), F.col("kind"), rules))

    hits = settled(hits)
    accept, review = F.lit(ACCEPT).cast("float"), F.lit(REVIEW).cast("float")
    strong = hits.where(F.col("score") >= accept).select("id", "entry", "score", F.explode("buckets").alias("bucket"))
    per_bucket = strong.groupBy("id", "bucket").agg(F.max(F.struct("score", (-F.col("entry")).alias("neg"))).alias("b"))
    split = per_bucket.withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("n > 1").select("id", (-F.col("b.neg")).alias("entry"), F.col("b.score").alias("score"))
    mixed = split.groupBy("id").agg(F.max("score").alias("confidence"))

    rest = hits.join(mixed, "id", "left_anti")
    anyone = rest.groupBy("id").agg(F.max("fits").alias("some_fit"))
    usable = rest.join(anyone, "id").where(F.col("fits") | ~F.col("some_fit"))
    top = usable.groupBy("id").agg(F.max(F.struct("score", (-F.col("entry")).alias("neg"), "kind", "fits")).alias("b")).select("id", (-F.col("b.neg")).alias("entry"), F.col("b.score").alias("score"), F.col("b.fits").alias("fits"))
    there = lambda df: df if records is None else df.join(records.select("entry"), "entry", "left_semi")
    taken = there(top.where(F.col("score") >= accept)).select(*top.columns)
    # candidates for review are of all formats
    low = rest.join(taken, "id", "left_anti").where(F.col("score") >= review)
    low = there(top_per_group(low, ["id"], REVIEW_ROWS, F.col("score").desc(), F.col("entry")))
    lows = low.groupBy("id").agg(F.max("score").alias("confidence"))

    none = F.lit(None).cast("bigint")
    one = F.lit(1.0).cast("float")
    sound = lambda c, k: F.when(fm.mismatch(F.col(c), F.col(k), rules).isNull(), F.lit("resolved")).otherwise(F.lit("ambiguous"))
    done = (
        by_id.select("id", F.lit("known_external_id").alias("path"), sound("formats", "known_kind").alias("status"), none.alias("entry"), F.col("known").cast("bigint").alias("series_id"), one.alias("confidence"))
        .unionByName(by_foreign.select("id", F.lit("foreign_id_lookup").alias("path"), sound("formats", "entry_kind").alias("status"), F.col("looked_up").cast("bigint").alias("entry"), none.alias("series_id"), one.alias("confidence")))
        .unionByName(mixed.select("id", F.lit("fuzzy_title").alias("path"), F.lit("review_pending").alias("status"), none.alias("entry"), none.alias("series_id"), "confidence"))
        .unionByName(taken.select("id", F.lit("fuzzy_title").alias("path"), F.when(F.col("fits"), F.lit("resolved")).otherwise(F.lit("ambiguous")).alias("status"), F.col("entry").cast("bigint").alias("entry"), none.alias("series_id"), F.col("score").alias("confidence")))
        .unionByName(lows.select("id", F.lit("fuzzy_title").alias("path"), F.lit("review_pending").alias("status"), none.alias("entry"), none.alias("series_id"), "confidence"))
    )
    best = hits.groupBy("id").agg(F.max("score").alias("score"))
    open_ = left.select("id").join(done.select("id"), "id", "left_anti").join(best, "id", "left")
    outcomes = done.unionByName(open_.select("id", F.lit(None).cast("string").alias("path"), F.lit("unresolved").alias("status"), none.alias("entry"), none.alias("series_id"), F.col("score").alias("confidence")))
    put_up = split.unionByName(low.select("id", "entry", "score")).select("id", F.col("entry").cast("bigint").alias("entry"), "score", reason(F.col("score")).alias("reason"))
    return outcomes, put_up


def resolve_to_fixed_point(releases: DataFrame, mapping: DataFrame, foreign: DataFrame, catalog: DataFrame, id_map: DataFrame, rules=fm.RULES) -> tuple[DataFrame, DataFrame]:
    """Two passes: entries accepted in the first become known ids for releases left open in it."""
    outcomes, put_up = resolve(releases, mapping, foreign, catalog, id_map, rules)
    made = outcomes.where("status = 'resolved' and entry is not null").select("entry").distinct().join(foreign, "entry").join(catalog.select("entry", "kind"), "entry")
    more = made.select("provider", "external_id", (-F.col("entry")).cast("bigint").alias("series_id"), "kind")
    again, _ = resolve(releases.join(outcomes.where("status = 'unresolved'").select("id"), "id", "left_semi"), mapping.select("provider", "external_id", F.col("series_id").cast("bigint"), "kind").unionByName(more), foreign, catalog, id_map, rules)
    gained = again.where("status = 'resolved'")
    return outcomes.join(gained.select("id"), "id", "left_anti").unionByName(gained), put_up


def resolve_and_persist(
    releases: DataFrame, series: DataFrame, mapping: DataFrame, foreign: DataFrame, catalog: DataFrame, id_map: DataFrame, provider: str, now: int, rules=fm.RULES, max_passes: int = 20
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Resolve releases, and make series of the entries that they lead to, until nothing more is resolved.

    ``catalog`` holds the provider's records: ``entry``, ``title``, ``kind``,
    ``foreign_ids`` and columns of ``series``.  Entries that a release is
    linked to or that are put up for its review get a series, new or stored
    (``entities.persist``); the ids that they bring are known to the next pass
    over the releases that are still open.  Returns the outcomes and review
    candidates, each with ``series_id``, and the series and mapping.
    """
    mapping, catalog = mapping.hint("merge"), catalog.hint("merge")
    kinds = mapping.groupBy("series_id").agg(F.first("kind").alias("kind"))
    known, left = mapping.select("provider", "external_id", F.col("series_id").cast("bigint").alias("series_id")), settled(releases)
    done, candidates_of = None, None
    for _ in range(max_passes):
        outcomes, put_up = resolve(left, known.join(kinds, "series_id"), foreign, catalog, id_map, rules)
        outcomes, put_up = settled(outcomes), settled(put_up)
        wanted = outcomes.select("entry").unionByName(put_up.select("entry")).where("entry is not null").distinct()
        records = settled(catalog.join(wanted, "entry").select(F.col("entry").cast("bigint").alias("place"), F.lit(provider).alias("provider"), F.col("entry").cast("string").alias("external_id"), *[c for c in catalog.columns if c != "entry"]))
        series, known, assigned = entities.persist(series, known, records, now)
        series, known, assigned = settled(series), settled(known), settled(assigned)
        made = assigned.join(records.select("place", "kind"), "place").select("series_id", "kind")
        kinds = settled(kinds.unionByName(made.join(kinds, "series_id", "left_anti")).groupBy("series_id").agg(F.first("kind").alias("kind")))
        of_entry = assigned.select(F.col("place").alias("entry"), F.col("series_id").alias("_made"))
        outcomes = settled(outcomes.join(of_entry, "entry", "left").withColumn("series_id", F.coalesce("series_id", "_made")).select("id", "path", "status", "entry", "series_id", "confidence"))
        put_up = settled(put_up.join(of_entry, "entry").select("id", "entry", F.col("_made").alias("series_id"), "score", "reason"))
        gained = outcomes.where("status <> 'unresolved'")
        done = outcomes if done is None else settled(done.join(gained.select("id"), "id", "left_anti").unionByName(gained))
        candidates_of = put_up if candidates_of is None else settled(candidates_of.unionByName(put_up))
        left = settled(left.join(outcomes.where("status = 'unresolved'").select("id"), "id", "left_semi"))
        if not gained.limit(1).count() or not left.limit(1).count():
            break
    return done, candidates_of, series, known
