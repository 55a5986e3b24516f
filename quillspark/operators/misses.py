"""A cache of lookups that found nothing, with expiry and a bound; and the provider's lookups through it.

The cache is a table of ``provider``, ``external_id``, ``recorded_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.functions.similarity import dice
from quillspark.operators.lineage import dealt, settled
from quillspark.operators.paging import top_per_group
from quillspark.operators.search import candidates, token_index

#: Seconds that a miss is believed; entries the cache holds.
TTL, CAP = 24 * 3600, 10_000
KEYS = ["provider", "external_id"]
#: Hits of a title query: usual number, greatest number.
HITS, MOST_HITS = 25, 100


def live(cache: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """Entries that are still believed."""
    return cache.where(F.col("recorded_at") > now - ttl)


def record(cache: DataFrame, missed: DataFrame, found: DataFrame, now: int, ttl: int = TTL, cap: int = CAP) -> DataFrame:
    """The cache after a batch: found keys and expired entries are forgotten, missed keys stamped ``now``.

    Where that would be more than ``cap`` entries, the newest half of ``cap``
    stays, of equally new ones the first by key.
    """
    kept = live(cache, now, ttl).join(found.select(*KEYS), KEYS, "left_anti").join(missed.select(*KEYS), KEYS, "left_anti")
    new = missed.select(*KEYS).distinct().withColumn("recorded_at", F.lit(now).cast("bigint"))
    both = kept.select(*KEYS, "recorded_at").unionByName(new)
    if both.limit(cap + 1).count() <= cap:
        return both
    return both.orderBy(F.col("recorded_at").desc(), *KEYS).limit(cap // 2)


def lookup(wanted: DataFrame, records: DataFrame, cache: DataFrame, now: int, ttl: int = TTL, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Records of the wanted keys and the cache after it; keys with a live miss are not looked up, even if there is a record now."""
    asked = wanted.select(*KEYS).distinct().join(live(cache, now, ttl).select(*KEYS), KEYS, "left_anti")
    found = asked.join(records, KEYS)
    missed = asked.join(records.select(*KEYS), KEYS, "left_anti")
    return found, record(cache, missed, found, now, ttl, cap)


def routed(queries: DataFrame, provider: str) -> DataFrame:
    """How each query is answered: ``route`` (``direct``, ``foreign``, ``title``, ``none``), ``id_provider``, ``id``, ``text``.

    ``queries``: ``query_id``, ``q``, ``external_id``, ``foreign_provider``.
    An id goes before a title.  It belongs to the named provider, else to that
    whose address it is, else to ``provider`` itself; numbers of the old
    scheme lead nowhere.
    """
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = queries.select("query_id", filled("q").alias("text"), filled("external_id").alias("given"), filled("foreign_provider").alias("named"))
    own = F.coalesce(ids.extract_id(F.col("named"), F.col("given")), F.col("given"))
    # settled, as what follows names it several times and the optimizer would copy it into each place
    rows = settled(rows.withColumn("own", own).withColumn("seen", F.when(F.col("named").isNull(), ids.detect(F.col("given")))))
    source = F.coalesce("named", "seen.provider", F.lit(provider))
    rows = rows.withColumn("id_provider", F.when(F.col("given").isNotNull(), source)).withColumn("id", F.when(F.col("named").isNotNull(), F.col("own")).otherwise(F.coalesce("seen.id", "given")))
    route = F.when(F.col("given").isNull(), F.when(F.col("text").isNotNull(), "title").otherwise("none")).when(F.col("id_provider") == ids.LEGACY, "none").when(F.col("id_provider") == provider, "direct").otherwise("foreign")
    return rows.select("query_id", route.alias("route"), "id_provider", "id", "text")


def answered(queries: DataFrame, provider: str, dump: DataFrame, foreign: DataFrame, limit: int = HITS) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank``: hits of title, id and address queries in one plan.

    ``dump``: ``id`` (text), ``title``; ``foreign``: ``provider``,
    ``external_id``, ``id``.  A record found by an id scores 1.0; titles that
    hold all words of a query are scored by Dice, the ``limit`` best stay.
    """
    limit = min(max(limit, 1), MOST_HITS)
    ways = settled(routed(queries, provider))
    direct = ways.where("route = 'direct'").select("query_id", "id").join(dump.select("id"), "id")
    by_foreign = ways.where("route = 'foreign'").select("query_id", F.col("id_provider").alias("provider"), F.col("id").alias("external_id")).join(foreign, ["provider", "external_id"])
    sure = direct.select("query_id", "id").unionByName(by_foreign.select("query_id", "id")).distinct()
    sure = sure.select("query_id", "id", F.lit(1.0).cast("float").alias("score"), F.lit(1).alias("rank"))
    titled = ways.where("route = 'title'").select("query_id", "text")
    return sure.unionByName(titled_hits(titled, dump, limit))


def titled_hits(queries: DataFrame, dump: DataFrame, limit: int) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank``: the ``limit`` best titles that hold all words of a query.

    Equal texts and equal titles are compared once.  Of records with one title
    only the first ``limit`` can be among the best of any query, as they are
    ranked by score and id.
    """
    texts = queries.select("text").distinct()
    first = settled(top_per_group(dealt(dump.select("id", "title"), "title"), ["title"], limit, F.col("id")))
    names = first.select("title").distinct()
    met = candidates(texts.select(F.col("text").alias("query_id"), "text"), token_index(names, "title", "title"))
    scored = met.select(F.col("query_id").alias("text"), F.col("id").alias("title"), dice(F.col("query_id"), F.col("id")).alias("score"))
    hits = scored.join(first.select("title", "id").hint("merge"), "title").select("text", "id", "score")
    best = top_per_group(hits, ["text"], limit, F.col("score").desc(), F.col("id"))
    return queries.join(best.hint("merge"), "text").select("query_id", "id", "score", "rank")
