"""Catalog queries: filters, joins, division, groups, paging, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import aggregates as ag
from quillspark.operators import filters as fi
from quillspark.operators import joins, paging
from quillspark.operators.lineage import dealt
from quillspark.plans.registry import query

NOW = 1700004000


# --- filters -----------------------------------------------------------------


@query("select id, kind, status, brand from series where kind in ('manga', 'novel') and status in ('ongoing', 'hiatus')")
def series_by_kind_and_status(series: DataFrame) -> DataFrame:
    keep = fi.all_of(fi.csv_filter("kind", " manga, ,novel"), fi.csv_filter("status", "ongoing,hiatus"), fi.csv_filter("brand", " , "))
    return series.where(keep).select("id", "kind", "status", "brand")


@query("select id from series where owned and wishlisted_at is null")
def series_owned_not_wished(series: DataFrame) -> DataFrame:
    return series.where(fi.all_of(fi.flag_filter(F.col("owned"), True), fi.present_filter("wishlisted_at", False), fi.flag_filter(F.col("owned"), None))).select("id")


@query("select metadata_source, count(*) as n from series where metadata_source <> 'manual' group by all")
def series_by_origin(series: DataFrame) -> DataFrame:
    return series.where(fi.all_of(fi.origin_filter("metadata_source", "auto"), fi.origin_filter("metadata_source", "any"))).groupBy("metadata_source").agg(F.count("*").alias("n"))


@query("select resolution_status, count(*) as n from releases where resolution_status in ('unresolved', 'ambiguous', 'review_pending') group by all")
def queue_statuses(releases: DataFrame) -> DataFrame:
    return releases.where(fi.status_filter("resolution_status", "no such status")).groupBy("resolution_status").agg(F.count("*").alias("n"))


@query("select id, title from series where title ilike '%an%' and title ilike '%l_e%'")
def title_words(series: DataFrame) -> DataFrame:
    return series.where(fi.token_filter("title", " AN  l_e ")).select("id", "title")


@query("select id, link from releases where link in ('https://feed.example/view/11', 'https://feed.example/view/11/')")
def release_by_link(releases: DataFrame) -> DataFrame:
    return releases.where(fi.free_text_filter("https://feed.example/view/11/ ", title="source_name")).select("id", "link")


@query("select id, external_id from releases where external_id = 'x7-1' or (source_name ilike '%EED%' and source_name ilike '%d5%')")
def release_by_words(releases: DataFrame) -> DataFrame:
    return releases.where(fi.free_text_filter("x7-1", title="source_name") | fi.free_text_filter("EED d5", title="source_name")).select("id", "external_id")


@query("select id, resolution_path from releases where resolution_path <> 'manual' or resolution_path is null")
def releases_not_manual(releases: DataFrame) -> DataFrame:
    return releases.where(fi.not_equal_or_null("resolution_path", "manual")).select("id", "resolution_path")


@query("""select id from releases where (files is null or description is null) and resolution_status in ('unresolved', 'ambiguous')
    and id in (select release_id from release_sources where source_name = 'feed3')""")
def missing_details(releases: DataFrame, release_sources: DataFrame) -> DataFrame:
    rows = releases.where((F.col("files").isNull() | F.col("description").isNull()) & F.col("resolution_status").isin("unresolved", "ambiguous"))
    return joins.carried_by(rows, release_sources, ["feed3"]).select("id")


@query("""select id, observed_at from releases where files is null and observed_at >= 800000000
    and id in (select release_id from release_sources where source_name = 'feed1') order by observed_at desc, id desc limit 5""")
def recent_without_files(releases: DataFrame, release_sources: DataFrame) -> DataFrame:
    rows = releases.where(F.col("files").isNull() & (F.col("observed_at") >= 800000000))
    return paging.newest(joins.carried_by(rows, release_sources, ["feed1"]), "observed_at", 5).select("id", "observed_at")


@query("select p_partkey as id, p_name from part where p_partkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def id_include(part: DataFrame, orders: DataFrame) -> DataFrame:
    ids = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return fi.only_ids(part.select(F.col("p_partkey").alias("id"), "p_name"), ids, ["id"])


@query("select p_partkey as id, p_name from part where not exists (select 1 from orders where o_custkey = p_partkey)")
def id_exclude(part: DataFrame, orders: DataFrame) -> DataFrame:
    return fi.except_ids(part.select(F.col("p_partkey").alias("id"), "p_name"), orders.select(F.col("o_custkey").alias("id")), ["id"])


@query("select id, list_position(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 2), 'and') > 0 as hit from documents_ where list_contains(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 2), 'and')".replace("documents_", "(select doc_id as id, text from documents)"))
def within_breadth(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").alias("id"), F.split("text", "[ \n]+").alias("queries"))
    return rows.where(fi.within_breadth("queries", "and", 2)).select("id", F.lit(True).alias("hit"))


@query("select id, status from series where status is null or status = 'ongoing'")
def active_series(series: DataFrame) -> DataFrame:
    state = F.when(F.col("status") == "ongoing", F.lit("active")).otherwise(F.when(F.col("status").isNotNull(), F.lit("merged")))
    return series.withColumn("state", state).where(fi.active_filter("state")).select("id", "status")


@query(f"""select s.id, e.external_id, s.fetched_at from series s join external_ids e on e.series_id = s.id and e.provider = 'anilist'
    where s.metadata_source <> 'manual' and s.fetched_at < {NOW} - 2000 order by s.fetched_at, s.id, e.external_id limit 100""")
def stale_batch(series: DataFrame, external_ids: DataFrame) -> DataFrame:
    ids = external_ids.where("provider = 'anilist'").select(F.col("series_id").alias("id"), "external_id")
    rows = series.where(fi.stale_filter("metadata_source", "fetched_at", NOW, 2000)).join(ids, "id")
    return rows.select("id", "external_id", "fetched_at").orderBy("fetched_at", "id", "external_id").limit(100)


@query("select id, metadata_hash, title from series where metadata_hash = 'h7' or id = 12")
def point_lookup(series: DataFrame) -> DataFrame:
    return series.where((F.col("metadata_hash") == "h7") | (F.col("id") == 12)).select("id", "metadata_hash", "title")


@query("""select id, observed_at from releases where resolution_status in ('unresolved', 'ambiguous', 'review_pending') and id in (select release_id from release_formats where format = 'cbz')
    order by observed_at desc, id desc limit 1000""")
def bulk_targets(releases: DataFrame, release_formats: DataFrame) -> DataFrame:
    ids = release_formats.where("format = 'cbz'").select(F.col("release_id").alias("id"))
    waiting = releases.where(fi.status_filter("resolution_status", None))
    return paging.newest(fi.only_ids(waiting, ids, ["id"]), "observed_at", 1000).select("id", "observed_at")


# --- joins -------------------------------------------------------------------


@query("""select rs.source_name, count(distinct r.series_id) as series from release_sources rs join releases r on r.id = rs.release_id
    where r.series_id is not null group by rs.source_name""")
def source_facet(releases: DataFrame, release_sources: DataFrame) -> DataFrame:
    linked = releases.where("series_id is not null").select(F.col("id").alias("release_id"), "series_id")
    # rows of few bytes: dealt, so that no task gets millions of them, and merged, as files of few bytes look fit for a broadcast
    joined = dealt(release_sources, "release_id").join(dealt(linked, "release_id").hint("merge"), "release_id")
    return joined.groupBy("source_name").agg(F.count_distinct("series_id").alias("series"))


@query("select g.genre, count(s.id) as n from (select distinct genre from series_genres) g left join series_genres x on x.genre = g.genre left join series s on s.id = x.series_id and s.owned group by g.genre")
def genre_facet(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    owned = series.where("owned").select(F.col("id").alias("series_id"), F.lit(1).alias("one"))
    return series_genres.join(owned, "series_id", "left").groupBy("genre").agg(F.count("one").alias("n"))


@query("select n_name, count(c_custkey) as n from nation left join (select * from customer where c_acctbal > 9000) on c_nationkey = n_nationkey group by n_name")
def vocabulary_with_zero_use(nation: DataFrame, customer: DataFrame) -> DataFrame:
    rich = customer.where("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return nation.select("n_nationkey", "n_name").join(rich, "n_nationkey", "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@query("select s.id, string_agg(g.genre, ';' order by g.genre) as genres from series s join series_genres g on g.series_id = s.id group by s.id")
def genres_by_series(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    page = joins.decorated(series.select("id"), series_genres.withColumnRenamed("series_id", "id"), "id", "genre", "genres")
    return page.where(F.size("genres") > 0).select("id", F.array_join("genres", ";").alias("genres"))


@query("select r.id, s.title, r.observed_at from releases r join series s on s.id = r.series_id order by r.observed_at desc, r.id desc limit 40")
def recent_with_titles(releases: DataFrame, series: DataFrame) -> DataFrame:
    rows = releases.select("id", "series_id", "observed_at").join(series.select(F.col("id").alias("series_id"), "title"), "series_id")
    return paging.newest(rows, "observed_at", 40).select("id", "title", "observed_at")


@query("select id, source_name from releases where id in (select release_id from release_sources where source_name in ('feed2', 'feed5'))")
def releases_carried_by(releases: DataFrame, release_sources: DataFrame) -> DataFrame:
    return joins.carried_by(releases, release_sources, ["feed2", "feed5"]).select("id", "source_name")


@query("select id from releases where id in (select release_id from release_formats where format = 'epub')")
def releases_with_format(releases: DataFrame, release_formats: DataFrame) -> DataFrame:
    return fi.only_ids(releases, release_formats.where("format = 'epub'").select(F.col("release_id").alias("id")), ["id"]).select("id")


@query("""select id, title from series where id in (select series_id from releases where id in (select release_id from release_sources where source_name = 'feed4') and resolution_status = 'resolved')""")
def series_carried_by(series: DataFrame, releases: DataFrame, release_sources: DataFrame) -> DataFrame:
    held = joins.carried_by(releases.where("resolution_status = 'resolved'"), release_sources, ["feed4"])
    return fi.only_ids(series, held.select(F.col("series_id").alias("id")), ["id"]).select("id", "title")


@query("select id from series where id in (select series_id from series_genres where genre in ('Brand#12', 'Brand#23'))")
def series_with_any_genre(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    return joins.with_any(series, series_genres.withColumnRenamed("series_id", "id"), "id", "genre", ["Brand#12", "Brand#23"]).select("id")


@query("""select id from series where id in (select series_id from series_genres where genre in ('Brand#12', 'Brand#22') group by series_id having count(distinct genre) = 2)""")
def series_with_all_genres(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    return joins.with_all(series, series_genres.withColumnRenamed("series_id", "id"), "id", "genre", ["Brand#12", "Brand#22"]).select("id")


@query("select id from series s where (select count(distinct genre) from series_genres g where g.series_id = s.id and genre in ('Brand#12', 'Brand#12')) = 2")
def series_with_all_genres_repeated(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    return joins.with_all(series, series_genres.withColumnRenamed("series_id", "id"), "id", "genre", ["Brand#12", "Brand#12"]).select("id")


@query("select id from series where id not in (select series_id from releases where series_id is not null and resolution_status = 'resolved')")
def series_without_releases(series: DataFrame, releases: DataFrame) -> DataFrame:
    return joins.without(series, releases.where("resolution_status = 'resolved'"), "id", "series_id").select("id")


@query("""select id, title from series s where not owned and wishlisted_at is null
    and not exists (select 1 from releases r where r.series_id = s.id and r.volume = 7)
    and not exists (select 1 from candidates c where c.series_id = s.id)
    and not exists (select 1 from library l where l.series_id = s.id and link_kind = 'manual')""")
def orphan_series(series: DataFrame, releases: DataFrame, candidates: DataFrame, library: DataFrame) -> DataFrame:
    return joins.orphans(series, releases.where("volume = 7"), candidates, library.where("link_kind = 'manual'")).select("id", "title")


@query("""select id from series where id in (select series_id from external_ids where (provider = 'anilist' and external_id in ('a4', 'a10', 'a200')) or (provider = 'mal' and external_id in ('m6', 'm9')))""")
def series_by_id_pairs(spark, series: DataFrame, external_ids: DataFrame) -> DataFrame:
    wanted = spark.createDataFrame([("anilist", "a4"), ("anilist", "a10"), ("anilist", "a200"), ("mal", "m6"), ("mal", "m9")], "provider string, external_id string")
    hits = fi.only_ids(external_ids, F.broadcast(wanted), ["provider", "external_id"])
    return fi.only_ids(series, hits.select(F.col("series_id").alias("id")), ["id"]).select("id")


_WORDS = "select doc_id as id, source, lang, regexp_split_to_array(text, '[ \\n]+') as w from documents"


def _split(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), "source", "lang", F.split("text", "[ \n]+").alias("w"))


@query(f"""select value, count(distinct id) as n from (select id, unnest(list_slice(w, 1, 2)) as value from ({_WORDS})) group by value having count(distinct id) >= 2""")
def release_groups(documents: DataFrame) -> DataFrame:
    return ag.groups_over(_split(documents), "w", "id", 2)


@query(f"""select value, count(distinct id) as n from (select id, unnest(w) as value from ({_WORDS})) group by value having count(distinct id) >= 20""")
def release_groups_all(documents: DataFrame) -> DataFrame:
    return ag.groups_over(_split(documents), "w", "id", 3, least=20)


@query(f"""select value, series_id, n, score_sum from (select value, series_id, count(*) as n, sum(score)::bigint as score_sum,
        row_number() over (partition by value order by count(*) desc, sum(score) desc, series_id) as rn
      from (select distinct id, unnest(list_slice(w, 1, 1)) as value from ({_WORDS})) join (select doc_id as release_id, cast(substr(source, 4) as bigint) as series_id, n_chars as score from documents) on release_id = id
      group by value, series_id) where rn = 1""")
def dominant_candidates(documents: DataFrame) -> DataFrame:
    found = documents.select(F.col("doc_id").alias("release_id"), F.expr("cast(substr(source, 4) as bigint)").alias("series_id"), F.col("n_chars").alias("score"))
    return ag.dominant_candidate(_split(documents), found, "w", 1)


@query("""select id, provider, external_id, series_id from (
      select k.id, k.provider, k.external_id, e.series_id, row_number() over (partition by k.id order by k.pos, e.series_id) as rn from (
        select o_orderkey as id, 0 as pos, 'anilist' as provider, concat('a', o_custkey) as external_id from orders
        union all select o_orderkey, 1, 'mal', concat('m', o_custkey) from orders) k
      join external_ids e on e.provider = k.provider and e.external_id = k.external_id) where rn = 1""")
def known_external_id(orders: DataFrame, external_ids: DataFrame) -> DataFrame:
    pair = lambda p, x: F.struct(F.lit(p).alias("provider"), F.concat(F.lit(x), F.col("o_custkey").cast("string")).alias("external_id"))
    keyed = orders.select(F.col("o_orderkey").alias("id"), F.posexplode(F.array(pair("anilist", "a"), pair("mal", "m"))).alias("pos", "k")).select("id", "pos", "k.*")
    return joins.first_match(keyed, external_ids, "id", "pos", ["provider", "external_id"]).select("id", "provider", "external_id", "series_id")


@query("""select provider, external_id, id from (select provider, external_id, id, gone, row_number() over (partition by provider, external_id order by gone, id) as rn from (
      select 'anilist' as provider, (p_partkey % 700)::varchar as external_id, p_partkey as id, p_size % 4 = 0 as gone from part
      union all select 'kitsu', p_size::varchar, p_partkey, p_size % 4 = 0 from part)) where rn = 1 and not gone""")
def foreign_id_winners(part: DataFrame) -> DataFrame:
    dump = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 700).alias("al"), F.col("p_size").alias("ki"), F.when(F.col("p_size") % 4 == 0, F.lit("merged")).otherwise(F.when(F.col("p_size") % 4 == 1, F.lit("active"))).alias("state"))
    return joins.unpivot_ids(dump, "id", {"anilist": "al", "kitsu": "ki"}, "state")


@query("select external_id, count(*) as n, min(series_id) as first_series, max(series_id) as last_series from external_ids where provider = 'anilist' group by external_id having count(*) > 1")
def ambiguous_ids(external_ids: DataFrame) -> DataFrame:
    return external_ids.where("provider = 'anilist'").groupBy("external_id").agg(F.count("*").alias("n"), F.min("series_id").alias("first_series"), F.max("series_id").alias("last_series")).where("n > 1")


@query("""select series_id, item, provider, external_id from (select *, row_number() over (partition by series_id order by place desc) as rn2 from (
      select k.place, k.item, k.provider, k.external_id, e.series_id, row_number() over (partition by k.place order by k.pos, e.series_id) as rn from (
        select c_custkey as place, c_name as item, 0 as pos, 'mal' as provider, concat('m', c_custkey % 500) as external_id from customer
        union all select c_custkey, c_name, 1, 'anilist', concat('a', c_custkey % 400) from customer) k
      join external_ids e on e.provider = k.provider and e.external_id = k.external_id) where rn = 1) where rn2 = 1""")
def library_sweep(customer: DataFrame, external_ids: DataFrame) -> DataFrame:
    pair = lambda p, x, m: F.struct(F.lit(p).alias("provider"), F.concat(F.lit(x), (F.col("c_custkey") % m).cast("string")).alias("external_id"))
    items = customer.select(F.col("c_custkey").alias("place"), F.col("c_name").alias("item"), F.array(pair("mal", "m", 500), pair("anilist", "a", 400)).alias("ids"))
    return joins.latest_item(items, external_ids)


# --- sorting and pages ---------------------------------------------------------


@query("select id, rating from series order by rating asc nulls last, id limit 50 offset 100")
def series_page_by_rating(series: DataFrame) -> DataFrame:
    ordered = paging.sorted_by(series, "rating", ["rating", "year", "wishlisted_at"], "updated_at", "asc")
    return paging.page_of(ordered, 3, None).select("id", "rating")


@query("select id, wishlisted_at from series order by wishlisted_at desc nulls last, id limit 200")
def series_page_by_wish(series: DataFrame) -> DataFrame:
    return paging.page_of(paging.sorted_by(series, "wishlisted_at", ["wishlisted_at"], "updated_at", None), 0, 5000).select("id", "wishlisted_at")


@query("select id, updated_at from series order by updated_at desc nulls last, id limit 50")
def series_page_default(series: DataFrame) -> DataFrame:
    return paging.page_of(paging.sorted_by(series, "no such column", ["rating"], "updated_at", "up"), 1, None).select("id", "updated_at")


@query("select id, lower(title) as folded from series order by lower(title), id limit 50")
def series_page_by_title(series: DataFrame) -> DataFrame:
    return series.withColumn("folded", F.lower("title")).orderBy("folded", "id").limit(50).select("id", "folded")


@query("select id, posted_at, observed_at from releases order by posted_at desc, observed_at desc, id desc limit 50")
def release_page(releases: DataFrame) -> DataFrame:
    return releases.orderBy(F.col("posted_at").desc(), F.col("observed_at").desc(), F.col("id").desc()).limit(50).select("id", "posted_at", "observed_at")


@query("""select id, updated_at, rtrim(replace(replace(base64(encode(concat(updated_at, ':', id))), '+', '-'), '/', '_'), '=') as cursor, true as has_more
    from series where updated_at > 0 and (updated_at > 1700000100 or (updated_at = 1700000100 and id > 50)) order by updated_at, id limit 100""")
def change_feed(series: DataFrame) -> DataFrame:
    return paging.feed_page(series, (1700000100, 50), None).select("id", "updated_at", "cursor", "has_more")


@query("select source, id, score, rank from (select source, id, score, row_number() over (partition by source order by score desc, id) as rank from queue where lang = 'en') where rank <= 5")
def top_per_source(queue: DataFrame) -> DataFrame:
    return paging.top_per_group(queue.where("lang = 'en'"), ["source"], 5, F.col("score").desc(), F.col("id")).select("source", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("""select id, score from (select id, rough, len(regexp_extract_all(text, 'the')) as score from (select id, text, score as rough from queue order by score desc, id limit 200)) order by score desc, rough desc, id limit 20""")
def pool_reranked(queue: DataFrame) -> DataFrame:
    rows = queue.withColumnRenamed("score", "n")
    return paging.reranked(rows, F.col("n"), 200, F.regexp_count("text", F.lit("the")).cast("bigint"), 20).select("id", "score")


@query("""select id, status from (select id, resolution_status as status, row_number() over (partition by resolution_status order by id) as rn from releases where resolution_status in ('unresolved', 'ambiguous')) where rn <= 30""")
def batches_per_status(releases: DataFrame) -> DataFrame:
    parts = [releases.where(F.col("resolution_status") == s).orderBy("id").limit(30) for s in ("unresolved", "ambiguous")]
    return parts[0].unionByName(parts[1]).select("id", F.col("resolution_status").alias("status"))


@query("select id, external_id from releases where source_name = 'feed2' and id not in (select release_id from release_sources where source_name = 'feed3')")
def not_seen_before(releases: DataFrame, release_sources: DataFrame) -> DataFrame:
    seen = release_sources.where("source_name = 'feed3'").select(F.col("release_id").alias("id"))
    return fi.except_ids(releases.where("source_name = 'feed2'"), seen, ["id"]).select("id", "external_id")


@query("""select s.id, s.title, s.owned or l.series_id is not null as owned, coalesce(r.n, 0) as releases, coalesce(g.genres, '') as genres from series s
    left join library l on l.series_id = s.id left join (select series_id, count(*) as n from releases where series_id is not null group by series_id) r on r.series_id = s.id
    left join (select series_id, string_agg(genre, ';' order by genre) as genres from series_genres group by series_id) g on g.series_id = s.id order by s.id limit 200""")
def decorated_page(series: DataFrame, library: DataFrame, releases: DataFrame, series_genres: DataFrame) -> DataFrame:
    page = series.select("id", "title", "owned").orderBy("id").limit(200)
    page = joins.decorated(page, series_genres.withColumnRenamed("series_id", "id"), "id", "genre", "genres")
    counts = releases.where("series_id is not null").groupBy(F.col("series_id").alias("id")).agg(F.count("*").alias("n"))
    links = library.select(F.col("series_id").alias("id"), F.lit(True).alias("linked"))
    rows = page.join(counts, "id", "left").join(links, "id", "left")
    return rows.select("id", "title", (F.col("owned") | F.coalesce("linked", F.lit(False))).alias("owned"), F.coalesce("n", F.lit(0)).alias("releases"), F.array_join("genres", ";").alias("genres"))
