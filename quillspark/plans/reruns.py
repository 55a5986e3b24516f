"""Queries on resolving anew, links by hand, dumps and what feeds carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.operators import joins, merges, retries
from quillspark.plans.registry import query
from quillspark.sources import feeds, snapshot

NOW = 1_800_000_000
_BY_HAND = "resolution_status = 'resolved' and coalesce(resolution_path, '') = 'manual'"


@query(f"""select id, resolution_status from (select *, row_number() over (partition by resolution_status order by observed_at desc, id) as place from releases
    where resolution_status in ('unresolved', 'ambiguous', 'review_pending', 'resolved') and not ({_BY_HAND})) where place <= 20""")
def retry_selected(releases: DataFrame) -> DataFrame:
    return retries.selected(releases, "all", 20).select("id", "resolution_status")


def _outcomes(rows: DataFrame) -> DataFrame:
    """Every fifth release leads to a series, others to a review or nowhere, and some fail."""
    at = F.col("id") % 5
    found = rows.where(F.col("id") % 11 != 0)
    status = F.when(at == 0, "resolved").when(at == 1, "ambiguous").when(at == 2, "review_pending").otherwise("unresolved")
    return found.select("id", F.when(at <= 1, F.col("partkey")).alias("series_id"), F.lit("fuzzy_title").alias("path"), F.lit(0.9).alias("confidence"), status.alias("status"))


#: One row for each id, as lines repeat.
_ONCE = "once as (select id, min(resolution_status) as resolution_status, min(resolution_path) as resolution_path, min(partkey) as partkey, min(series_id) as series_id, min(resolution_attempts) as resolution_attempts from releases group by id)"
_RETRIED = f"""{_ONCE}, chosen as (select id from once where resolution_status in ('unresolved', 'ambiguous', 'rejected') and id % 2 = 0 union all select -id from once where id % 100 = 0),
    asked as (select c.id, r.id is not null as there, r.resolution_status not in ('rejected', 'standalone') and coalesce(r.resolution_path, '') <> 'manual' as free from chosen c left join once r using (id)),
    got as (select *, case when not there or (free and id % 11 = 0) then 'error' when not free then 'skipped' when id % 5 = 0 then 'resolved' when id % 5 = 1 then 'ambiguous' when id % 5 = 2 then 'review_pending' else 'unresolved' end as status from asked)"""


def _retried(releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    columns = ["resolution_status", "resolution_path", "partkey", "series_id", "resolution_attempts"]
    releases = releases.groupBy("id").agg(*[F.min(c).alias(c) for c in columns], F.lit(None).cast("double").alias("resolution_confidence"), F.lit(None).cast("bigint").alias("resolved_at"))
    chosen = releases.where(F.col("resolution_status").isin("unresolved", "ambiguous", "rejected") & (F.col("id") % 2 == 0)).select("id")
    return retries.retried(releases, chosen.unionByName(releases.where("id % 100 = 0").select((-F.col("id")).alias("id"))), _outcomes, NOW)


@query(f"""with {_RETRIED} select count(*) filter (status = 'resolved') as resolved, count(*) filter (status = 'ambiguous') as ambiguous, count(*) filter (status = 'review_pending') as review_pending, count(*) filter (status = 'unresolved') as unresolved,
    count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'error') as errors from got""")
def retried_tally(releases: DataFrame) -> DataFrame:
    return _retried(releases)[1]


@query(f"""with {_RETRIED} select r.id, case when g.id is null then r.resolution_status else g.status end as resolution_status, case when g.id is null then r.series_id when g.id % 5 <= 1 then r.partkey end as series_id, r.resolution_attempts + (g.id is not null)::int as resolution_attempts
    from once r left join (select * from got where status not in ('skipped', 'error')) g using (id)""")
def retried_releases(releases: DataFrame) -> DataFrame:
    return _retried(releases)[0].select("id", "resolution_status", "series_id", "resolution_attempts")


@query("""with asked as (select p_partkey as id, case when p_partkey % 3 = 0 then p_partkey when p_partkey % 3 = 1 then null else p_partkey + 100000000 end as sid, case when p_partkey % 3 = 1 then concat('m', p_partkey // 2) end as ext from part),
    got as (select a.*, s.id as there, e.series_id as held from asked a left join series s on s.id = a.sid left join (select * from external_ids where provider = 'mal') e on e.external_id = a.ext),
    made as (select ext, 10000 + row_number() over (order by min(id)) - 1 as series_id from got where ext is not null and held is null and id % 7 <> 0 and (id // 2) % 7 <> 0 group by ext)
    select g.id, coalesce(g.there, g.held, (select max(id) from series) + m.series_id - 9999) as series_id, case when g.sid is not null and g.there is null then 'not_found' when g.ext is not null and g.held is null and m.ext is null then 'no_record' end as error
    from got g left join made m on m.ext = g.ext""".replace("and id % 7 <> 0 and (id // 2) % 7 <> 0", "and (id // 2) % 7 <> 0"))
def linked_by_hand(spark, part: DataFrame, series: DataFrame, external_ids: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    requests = part.select(
        k.alias("request"),
        F.when(k % 3 == 0, k).when(k % 3 == 2, k + 100_000_000).alias("series_id"),
        F.when(k % 3 == 1, F.lit("mal")).alias("provider"),
        F.when(k % 3 == 1, F.concat(F.lit("m"), F.expr("cast(p_partkey div 2 as string)"))).alias("external_id"),
    )
    none = F.array().cast("array<struct<provider:string,id:string>>")
    records = part.where("p_partkey % 7 <> 0").select(F.lit("mal").alias("provider"), F.concat(F.lit("m"), k.cast("string")).alias("external_id"), none.alias("foreign_ids"), F.col("p_name").alias("title"))
    blank = spark.createDataFrame([], "id bigint, series_id bigint, resolution_path string, resolution_confidence double, resolution_status string, resolution_attempts int, resolved_at bigint")
    done, _, _, _ = retries.linked_by_hand(requests, blank, series.select("id", "title", "metadata_source", "updated_at"), external_ids, records, NOW)
    return done.select(F.col("request").alias("id"), "series_id", "error")


# --- histories, purges ----------------------------------------------------------------


@query("""select captured_at, waiting from (select d as captured_at, count(*) as waiting from (select id, observed_at // 86400 * 86400 as d from releases) group by d) where captured_at % (86400 * 3) = 0
    union all select 1900000000, count(*) from releases where resolution_status = 'unresolved'""")
def queue_history(releases: DataFrame) -> DataFrame:
    day = F.expr("observed_at div 86400 * 86400").alias("captured_at")
    history = releases.groupBy(day).agg(F.count("*").alias("waiting")).where("captured_at % (86400 * 3) = 0")
    now = releases.where("resolution_status = 'unresolved'").agg(F.count("*").alias("waiting")).withColumn("captured_at", F.lit(1900000000).cast("bigint"))
    once = merges.appended(history, now, "captured_at")
    return merges.appended(once, now, "captured_at")


_GONE = "select id from series where not owned and wishlisted_at is null and id not in (select series_id from library) and id not in (select series_id from candidates)"


@query(f"""with gone as ({_GONE}) select 'series' as name, count(*) as n, sum(id)::bigint as ids from series where id not in (select id from gone) union all select 'genres', count(*), sum(series_id)::bigint from series_genres where series_id not in (select id from gone)
    union all select 'external_ids', count(*), sum(series_id)::bigint from external_ids where series_id not in (select id from gone) union all select 'library', count(*), sum(series_id)::bigint from library""")
def purged_tables(spark, series: DataFrame, series_genres: DataFrame, external_ids: DataFrame, library: DataFrame, candidates: DataFrame) -> DataFrame:
    gone = joins.orphans(series, spark.createDataFrame([], "series_id bigint"), candidates, library)
    left = merges.purge({"series": series, "genres": series_genres, "external_ids": external_ids, "library": library}, gone, {"series": "id", "genres": "series_id", "external_ids": "series_id", "library": "series_id"})
    rows = [df.agg(F.count("*").alias("n"), F.sum("id" if name == "series" else "series_id").alias("ids")).select(F.lit(name).alias("name"), "n", "ids") for name, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# --- dumps and feeds --------------------------------------------------------------------


def _dump(part: DataFrame) -> DataFrame:
    state = F.when(F.col("p_size") % 5 == 0, "merged").when(F.col("p_size") % 5 == 1, "deleted").when(F.col("p_size") % 5 == 2, "active").when(F.col("p_size") % 5 == 3, "hidden")
    return part.select(F.col("p_partkey").alias("id"), state.alias("state"), F.expr("p_partkey div 2").alias("mal"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a"), F.col("p_partkey").cast("string"))).alias("anilist"))


@query("select p_partkey as id from part where p_partkey % 3 = 0 and p_size % 5 > 1")
def dump_lookups(part: DataFrame) -> DataFrame:
    wanted = part.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise("-5").alias("external_id"))
    return snapshot.by_id(_dump(part), wanted).select("id")


@query("""with d as (select p_partkey as id, coalesce(p_size % 5 in (2, 4), false) as live, p_partkey // 2 as mal, case when p_partkey % 3 = 0 then concat('a', p_partkey) end as anilist from part),
    i as (select 'mal' as provider, mal::varchar as external_id, id, live from d union all select 'anilist', anilist, id, live from d where anilist is not null)
    select provider, external_id, min(id) filter (live) as id from i group by provider, external_id having count(*) filter (live) > 0""")
def dump_sources(part: DataFrame) -> DataFrame:
    return snapshot.by_source(_dump(part), {"mal": "mal", "anilist": "anilist"})


@query("""select s_suppkey as path, case when s_suppkey % 3 = 0 then 'new' else 'same' end as etag from supplier where s_suppkey % 3 = 0 or s_suppkey % 5 = 0""")
def changed_files(supplier: DataFrame) -> DataFrame:
    now = supplier.select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 3 == 0, "new").otherwise("same").alias("etag"))
    before = supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 7 == 0, "same").otherwise("same").alias("etag"))
    return feeds.changed_files(now, before)


@query("select o_orderkey as external_id from orders where o_orderkey % 4 <> 0")
def unseen_items(orders: DataFrame) -> DataFrame:
    items = orders.select(F.col("o_orderkey").alias("external_id"))
    return feeds.unseen(items, items.where("external_id % 4 = 0"))


@query("""select p_partkey as id, case when p_partkey % 8 < 4 then p_partkey::varchar end as post from part""")
def imported_ids(part: DataFrame) -> DataFrame:
    key, at = F.col("p_partkey").cast("string"), F.col("p_partkey") % 8
    address = F.when(at == 0, F.concat(F.lit("https://feed.example/view/"), key)).when(at == 1, F.concat(F.lit(" http://FEED.example/download/"), key, F.lit(".torrent "))).when(at == 2, F.concat(F.lit("https://feed.example/view/"), key, F.lit("?x=1#c")))
    address = address.when(at == 3, F.concat(F.lit("https://feed.example//view/"), key, F.lit("/comments"))).when(at == 4, F.concat(F.lit("https://feed.example.org/view/"), key)).when(at == 5, F.concat(F.lit("https://feed.example/user/"), key)).when(at == 6, F.concat(F.lit("ftp://feed.example/view/"), key))
    return part.select(F.col("p_partkey").alias("id"), ids.imported_id(F.coalesce(address, F.lit("https://feed.example/view/x")), "https://feed.example").alias("post"))
