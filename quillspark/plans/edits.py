"""Merges and edits, as the table they leave behind; coverage; exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import values as va
from quillspark.operators import aggregates as ag
from quillspark.operators import entities, export, joins, merges
from quillspark.plans.registry import query

NOW = 1800000000

_STORED = "select o_orderkey as k, o_custkey as title, case when o_orderkey % 3 = 0 then o_orderpriority end as files, o_totalprice as span, 'old' as origin from orders where o_orderkey % 5 <> 0"
_COMING = "select o_orderkey as k, o_custkey + 1 as title, case when o_orderkey % 2 = 0 then o_orderstatus end as files, o_totalprice + 1 as span, 'new' as origin from orders where o_orderkey % 4 = 0"


def _orders(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = [F.lit("feed").alias("source_kind"), F.col("o_orderkey").alias("external_id")]
    stored = orders.where("o_orderkey % 5 <> 0").select(*key, F.col("o_custkey").alias("title"), F.expr("case when o_orderkey % 3 = 0 then o_orderpriority end").alias("files"), F.col("o_totalprice").alias("span"), F.lit("old").alias("origin"))
    coming = orders.where("o_orderkey % 4 = 0").select(*key, (F.col("o_custkey") + 1).alias("title"), F.expr("case when o_orderkey % 2 = 0 then o_orderstatus end").alias("files"), (F.col("o_totalprice") + 1).alias("span"), F.lit("new").alias("origin"))
    return stored, coming


@query(f"""select coalesce(s.k, i.k) as k, case when i.k is not null then i.title else s.title end as title,
      case when i.k is null or (i.files is null and s.files is not null) then s.files else i.files end as files,
      case when i.k is null or (i.files is null and s.files is not null) then s.span else i.span end as span,
      case when s.k is not null then s.origin else i.origin end as origin
    from ({_STORED}) s full join ({_COMING}) i on s.k = i.k""")
def release_upsert(orders: DataFrame) -> DataFrame:
    stored, coming = _orders(orders)
    return merges.upsert_releases(stored, coming, ["title"], ["files", "span"]).select(F.col("external_id").alias("k"), "title", "files", "span", "origin")


@query(f"""select coalesce(s.k, i.k) as k, coalesce(i.title, s.title) as title, case when i.k is not null then i.files else s.files end as files, coalesce(s.origin, i.origin) as origin
    from ({_STORED}) s full join ({_COMING}) i on s.k = i.k""")
def series_upsert(orders: DataFrame) -> DataFrame:
    stored, coming = _orders(orders)
    pick = ["external_id", "title", "files", "origin"]
    return merges.upsert(stored.select(*pick), coming.select(*pick), ["external_id"], ["title", "files"]).withColumnRenamed("external_id", "k")


@query("""select release_id, source_name from release_sources where source_name <> 'feed6' union select release_id, source_name from release_sources where source_name in ('feed5', 'feed6')""")
def bridge_insert_ignore(release_sources: DataFrame) -> DataFrame:
    return merges.insert_ignore(release_sources.where("source_name <> 'feed6'"), release_sources.where("source_name in ('feed5', 'feed6')"), ["release_id", "source_name"])


@query("""with stored as (select * from external_ids where series_id % 3 = 0),
    fresh as (select * from external_ids e where series_id % 3 <> 0 and not exists (select 1 from stored s where s.provider = e.provider and s.external_id = e.external_id) and not exists (select 1 from stored s where s.provider = e.provider and s.series_id = e.series_id)),
    by_id as (select provider, external_id, min(series_id) as series_id from fresh group by 1, 2),
    by_series as (select provider, series_id, arg_min(external_id, series_id) as external_id from by_id group by 1, 2)
    select provider, external_id, series_id from (select distinct on (provider, external_id) * from stored order by provider, external_id, series_id) union all select provider, external_id, series_id from by_series""")
def external_id_guards(external_ids: DataFrame) -> DataFrame:
    stored = external_ids.where("series_id % 3 = 0").groupBy("provider", "external_id").agg(F.min("series_id").alias("series_id"))
    return merges.insert_external_ids(stored, external_ids.where("series_id % 3 <> 0").withColumn("place", F.col("series_id")))


@query("select release_id, series_id, score from candidates where release_id % 3 <> 0 union all select release_id, series_id + 1, score * 2 from candidates where release_id % 6 = 0")
def candidates_replaced(candidates: DataFrame) -> DataFrame:
    new = candidates.where("release_id % 6 = 0").select("release_id", (F.col("series_id") + 1).alias("series_id"), (F.col("score") * 2).alias("score"))
    return merges.replace_for_keys(candidates, new, candidates.where("release_id % 3 = 0").select("release_id").distinct(), "release_id")


@query(f"""select id, case when hit then null else series_id end as series_id, case when hit then 'rejected' else resolution_path end as resolution_path,
    case when hit then 'rejected' else resolution_status end as resolution_status, resolution_attempts + hit::int as resolution_attempts,
    case when hit then null else resolution_confidence end as resolution_confidence, case when hit then {NOW} end as last_resolve_attempt_at from (select *, id % 10 = 1 as hit from releases)""")
def bulk_reject(releases: DataFrame) -> DataFrame:
    rows = releases.select("id", "series_id", "resolution_path", "resolution_status", "resolution_attempts", "resolution_confidence").withColumn("last_resolve_attempt_at", F.lit(None).cast("bigint"))
    return merges.reject(rows, rows.where("id % 10 = 1").select("id"), NOW)


_LINKED = f"""select id, case when hit then new_series else series_id end as series_id, case when hit then 'fuzzy_title' else resolution_path end as resolution_path,
    resolution_attempts + hit::int as resolution_attempts, case when hit and new_series is not null then coalesce(resolved_at, {NOW}) else resolved_at end as resolved_at
    from (select *, id % 3 = 0 as hit, case when id % 2 = 0 then id % 100 end as new_series from releases)"""


def _linked(releases: DataFrame) -> DataFrame:
    outcomes = releases.where("id % 3 = 0").select("id", F.expr("case when id % 2 = 0 then id % 100 end").alias("series_id"), F.lit("fuzzy_title").alias("path"), F.lit(0.9).alias("confidence"), F.lit("resolved").alias("status")).dropDuplicates(["id"])
    rows = releases.select("id", "series_id", "resolution_path", "resolution_confidence", "resolution_status", "resolution_attempts", "resolved_at")
    return merges.link(rows, outcomes, NOW)


@query(_LINKED)
def link_releases(releases: DataFrame) -> DataFrame:
    return _linked(releases).select("id", "series_id", "resolution_path", "resolution_attempts", "resolved_at")


@query(f"""with after as ({_LINKED}), moved as (select b.series_id as old, a.series_id as new from releases b join after a on a.id = b.id where a.series_id is distinct from b.series_id)
    select series_id from (select old as series_id from moved union select new from moved) where series_id is not null""")
def affected_series(releases: DataFrame) -> DataFrame:
    return merges.affected_series(releases, _linked(releases))


@query("select id, case when id % 5 = 0 and not owned then 1 else wishlisted_at end as wishlisted_at, id % 5 = 0 and not owned as edited from series")
def wishlist_edit(series: DataFrame) -> DataFrame:
    ids = series.where("id % 5 = 0").select("id")
    return merges.edit(series, ids, ~F.col("owned"), wishlisted_at=F.lit(1).cast("bigint")).select("id", "wishlisted_at", "edited")


@query("""select id, case when hit and metadata_source <> 'manual' then null else metadata_hash end as metadata_hash, hit and metadata_source <> 'manual' and metadata_hash is not null as invalidated, hit and metadata_source = 'manual' as skipped
    from (select *, id in (select series_id from external_ids where provider = 'mal') as hit from series)""")
def hash_invalidation(series: DataFrame, external_ids: DataFrame) -> DataFrame:
    return merges.invalidate_hashes(series, external_ids.where("provider = 'mal'")).select("id", "metadata_hash", "invalidated", "skipped")


@query("select series_id, genre from series_genres where series_id not in (select id from series where not owned and wishlisted_at is null and id not in (select series_id from library))")
def orphan_purge(spark, series: DataFrame, series_genres: DataFrame, library: DataFrame) -> DataFrame:
    none = spark.createDataFrame([], "series_id bigint")
    gone = joins.orphans(series, none, none, library)
    return merges.purge({"genres": series_genres}, gone, {"genres": "series_id"})["genres"]


@query("""select series_id, item, link_kind from library where link_kind = 'manual'
    union all select series_id, concat('n', series_id) as item, 'auto' as link_kind from (select distinct series_id from external_ids) where series_id not in (select series_id from library where link_kind = 'manual')""")
def library_merge(library: DataFrame, external_ids: DataFrame) -> DataFrame:
    found = external_ids.select("series_id").distinct().withColumn("item", F.concat(F.lit("n"), F.col("series_id").cast("string")))
    return merges.merge_library_links(library.select("series_id", "item", "link_kind"), found)


@query(f"""select s.id, case when hit then concat('new', s.id) else title end as title, case when hit then 'n' else metadata_hash end as metadata_hash, case when hit then {NOW} else updated_at end as updated_at
    from (select *, metadata_source <> 'manual' and id in (select series_id from external_ids where provider = 'mal') as hit from series) s""")
def series_from_metadata(series: DataFrame, external_ids: DataFrame) -> DataFrame:
    mal = external_ids.where("provider = 'mal'")
    records = mal.select("external_id", F.array().cast("array<struct<provider:string,id:string>>").alias("foreign_ids"))
    located = merges.locate_series(records, external_ids, "mal").withColumn("title", F.concat(F.lit("new"), F.col("series_id").cast("string"))).withColumn("metadata_hash", F.lit("n"))
    rows = series.select("id", "title", "metadata_hash", "metadata_source", "updated_at")
    return merges.upsert_from_metadata(rows, located, ["title"], NOW).drop("metadata_source")


@query("""select record, min_by(series_id, pos) as series_id from (
      select k.record, k.pos, e.series_id from (select p_partkey as record, 0 as pos, 'anilist' as provider, concat('a', p_partkey) as id from part union all select p_partkey, 1, 'mal', concat('m', p_partkey * 3) from part) k
      join external_ids e on e.provider = k.provider and e.external_id = k.id
      where k.record % 2 = 1 and not exists (select 1 from external_ids h where h.provider = 'mal' and h.series_id = e.series_id and h.external_id <> concat('r', k.record)))
    group by record""".replace("min_by(series_id, pos)", "arg_min(series_id, pos * 100000000 + series_id)"))
def located_by_foreign_id(part: DataFrame, external_ids: DataFrame) -> DataFrame:
    pair = lambda p, v: F.struct(F.lit(p).alias("provider"), v.alias("id"))
    records = part.where("p_partkey % 2 = 1").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("external_id"), F.array(pair("anilist", F.concat(F.lit("a"), F.col("p_partkey").cast("string"))), pair("mal", F.concat(F.lit("m"), (F.col("p_partkey") * 3).cast("string")))).alias("foreign_ids"))
    found = merges.locate_series(records, external_ids, "mal").where("series_id is not null")
    return found.select(F.substring("external_id", 2, 20).cast("bigint").alias("record"), "series_id")


@query(f"""with made as (select concat('n', p_partkey) as external_id, p_name as title from part where p_partkey % 3 = 0),
    top as (select max(id) as last from series)
    select id, title, metadata_source, updated_at from series
    union all select last + row_number() over (order by substr(sha256(external_id), 1, 2), external_id), concat('new ', title), 'provider', {NOW} from made, top""")
def series_inserted(series: DataFrame, part: DataFrame, external_ids: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<provider:string,id:string>>")
    new = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("external_id"), none.alias("foreign_ids"), F.concat(F.lit("new "), F.col("p_name")).alias("title"))
    known = part.where("p_partkey % 3 = 1").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("external_id"), none.alias("foreign_ids"), F.col("p_name").alias("title"))
    held = external_ids.where("provider = 'mal'").select("external_id")
    located = merges.locate_series(new.unionByName(known.join(held, "external_id", "left_semi")), external_ids, "mal")
    return merges.insert_from_metadata(series.select("id", "title", "metadata_source", "updated_at"), located, NOW)


_RECORDS = """select p_partkey as place, case when p_partkey % 3 = 1 then 'anilist' else 'mal' end as provider,
    concat(case when p_partkey % 3 = 1 then 'a' when p_partkey % 3 = 2 and (p_partkey // 3) % 5 = 0 then 'n' else 'm' end, p_partkey // 3) as external_id, p_partkey // 3 as grp from part"""
_STORED_IDS = "select distinct 'kitsu' as provider, concat('t', p_partkey // 3) as external_id, 1000000 + p_partkey // 3 as series_id from part where (p_partkey // 3) % 4 = 0"


@query(f"""with recursive records as ({_RECORDS}), mapping as ({_STORED_IDS}),
    ids as (select place, provider as p, external_id as e from records union all select place, 'kitsu', concat('t', grp) from records where place % 3 < 2 union all select place, 'mu', concat('u', grp) from records where place % 3 > 0),
    edges as (select distinct a.place as x, b.place as y from ids a join ids b on a.p = b.p and a.e = b.e),
    reach as (select place, place as r from records union select reach.place, edges.y from reach join edges on edges.x = reach.r),
    comp as (select place, min(r) as comp from reach group by place),
    held as (select comp, min(series_id) as series_id from comp join ids using (place) join mapping m on m.provider = ids.p and m.external_id = ids.e group by comp),
    firsts as (select comp, provider, arg_min(external_id, place) as first from comp join records using (place) group by comp, provider)
    select r.place, case when r.external_id = f.first then h.series_id end as series_id,
      case when r.external_id <> f.first then min(r.place) over (partition by c.comp, r.provider, r.external_id) when h.series_id is null then c.comp end as founder
    from records r join comp c using (place) join firsts f on f.comp = c.comp and f.provider = r.provider left join held h on h.comp = c.comp""")
def entities_assigned(part: DataFrame) -> DataFrame:
    grp = F.expr("cast(p_partkey div 3 as string)")
    pair = lambda p, v: F.struct(F.lit(p).alias("provider"), F.concat(F.lit(v), grp).alias("id"))
    at = F.col("p_partkey") % 3
    lists = F.when(at == 0, F.array(pair("kitsu", "t"))).when(at == 1, F.array(pair("kitsu", "t"), pair("mu", "u"))).otherwise(F.array(pair("mu", "u")))
    own = F.when(at == 1, "a").when((at == 2) & F.expr("(p_partkey div 3) % 5 = 0"), "n").otherwise("m")
    records = part.select(F.col("p_partkey").alias("place"), F.when(at == 1, "anilist").otherwise("mal").alias("provider"), F.concat(own, grp).alias("external_id"), lists.alias("foreign_ids"))
    stored = part.where("(p_partkey div 3) % 4 = 0").select(F.lit("kitsu").alias("provider"), F.concat(F.lit("t"), grp).alias("external_id"), F.expr("1000000 + p_partkey div 3").alias("series_id")).distinct()
    return entities.assign(records, stored)[0]


@query("""with q as (select p_partkey as request, case when p_partkey % 5 in (0, 4) then p_partkey + case when p_partkey % 2 = 0 then 0 else 100000000 end end as sid,
      case when p_partkey % 5 in (1, 2, 4) then 'mal' end as provider, case when p_partkey % 5 in (1, 2) then concat('m', p_partkey) end as ext from part),
    r as (select q.*, s.id is not null as there, e.series_id as held, q.ext is not null and q.request % 4 <> 0 as listed from q left join series s on s.id = q.sid left join external_ids e on e.provider = q.provider and e.external_id = q.ext)
    select request, case when provider is null and sid is not null and there then sid when sid is null and ext is not null then held end as series_id,
      coalesce(sid is null and ext is not null and held is null and listed, false) as make,
      case when not ((sid is not null and provider is null) or (sid is null and ext is not null)) then 'bad_request' when sid is not null and not there then 'not_found' when sid is null and held is null and not listed then 'no_record' end as error from r""")
def link_requests(part: DataFrame, series: DataFrame, external_ids: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    requests = part.select(
        k.alias("request"),
        F.when((k % 5).isin(0, 4), k + F.when(k % 2 == 0, 0).otherwise(100000000)).alias("series_id"),
        F.when((k % 5).isin(1, 2, 4), F.lit("mal")).alias("provider"),
        F.when((k % 5).isin(1, 2), F.concat(F.lit("m"), k.cast("string"))).alias("external_id"),
    )
    records = part.where("p_partkey % 4 <> 0").select(F.lit("mal").alias("provider"), F.concat(F.lit("m"), k.cast("string")).alias("external_id"))
    return merges.link_targets(requests, series, external_ids, records)


# --- coverage --------------------------------------------------------------------

_SPANS = """select series_id, case when id % 3 = 0 then id % 40 + id % 4 else id % 40 end::double as s, case when id % 3 = 0 then id % 40 else id % 40 + id % 4 end::double as e, observed_at, posted_at
    from releases where series_id is not null"""
_ISLANDS = f"""
    flat as (select series_id, least(s, e) as s, greatest(s, e) as e from ({_SPANS})),
    marked as (select *, case when s > max(e) over (partition by series_id order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as gap from flat),
    numbered as (select *, sum(gap) over (partition by series_id order by s, e rows unbounded preceding) as island from marked),
    merged as (select series_id, island, min(s) as s, max(e) as e from numbered group by series_id, island),
    cover as (select series_id, string_agg(concat(s::bigint, '-', e::bigint), ';' order by s) as volumes, max(e) as highest_volume from merged group by series_id)"""


def _with_spans(releases: DataFrame) -> DataFrame:
    low, high = F.expr("cast(id % 40 as double)"), F.expr("cast(id % 40 + id % 4 as double)")
    turned = F.col("id") % 3 == 0
    span = F.array(F.struct(F.when(turned, high).otherwise(low).alias("start"), F.when(turned, low).otherwise(high).alias("end")))
    return releases.withColumn("volume_span", span).withColumn("chapter_span", F.lit(None).cast("array<struct<start:double,end:double>>"))


def _written(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("bigint").cast("string"), F.lit("-"), s["end"].cast("bigint").cast("string"))), ";")


@query(f"with {_ISLANDS} select c.series_id, volumes, highest_volume, o as last_discovered_at, p as last_release_at from cover c join (select series_id, max(observed_at) as o, max(posted_at) as p from ({_SPANS}) group by series_id) t using (series_id)")
def coverage(releases: DataFrame) -> DataFrame:
    return ag.coverage(_with_spans(releases)).select("series_id", _written("volumes").alias("volumes"), "highest_volume", "last_discovered_at", "last_release_at")


@query(f"""with {_ISLANDS}, times as (select series_id, max(observed_at) as o, max(posted_at) as p from ({_SPANS}) group by series_id)
    select s.id, coalesce(volumes, '') as volumes, coalesce(volumes, '') <> '' as changed, case when coalesce(volumes, '') <> '' then {NOW} else s.updated_at end as updated_at, o as last_discovered_at, coalesce(p, 0) as last_release_at
    from series s left join cover c on c.series_id = s.id left join times t on t.series_id = s.id""")
def coverage_recompute(series: DataFrame, releases: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<start:double,end:double>>")
    out = ag.recompute_coverage(series.select("id", empty.alias("volumes"), empty.alias("chapters"), "updated_at"), _with_spans(releases), NOW)
    return out.select("id", _written("volumes").alias("volumes"), "changed", "updated_at", "last_discovered_at", "last_release_at")


@query("""select s.id, coalesce(r.last_seen, 0) as last_seen from series s left join (select series_id, max(observed_at) as last_seen from releases group by series_id) r on r.series_id = s.id""")
def last_seen_backfill(series: DataFrame, releases: DataFrame) -> DataFrame:
    seen = releases.where("series_id is not null").groupBy(F.col("series_id").alias("id")).agg(F.max("observed_at").alias("last_seen"))
    return series.select("id").join(seen, "id", "left").select("id", F.coalesce("last_seen", F.lit(0)).alias("last_seen"))


@query("""select id, case when id % 13 = 0 then 'ignored' when have_volume < year % 9 or have_chapter < year % 50 then 'behind' when have_volume is not null or have_chapter is not null then 'complete' else 'present' end as presence
    from series join library on series_id = id""")
def library_presence(series: DataFrame, library: DataFrame) -> DataFrame:
    rows = series.join(library.withColumnRenamed("series_id", "id"), "id")
    state = va.presence(F.col("id") % 13 == 0, F.col("year") % 9, F.col("year") % 50, F.col("have_volume"), F.col("have_chapter"))
    return rows.select("id", state.alias("presence"))


# --- exports ---------------------------------------------------------------------


def _export_rows(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    rows = joins.decorated(series.select("id", "title", "kind", "rating", "owned"), series_genres.withColumnRenamed("series_id", "id"), "id", "genre", "genres")
    return rows.withColumn("title", F.when(F.col("id") % 50 == 0, F.concat(F.col("title"), F.lit(', "the | second"'))).otherwise(F.col("title")))


_EXPORTED = """(select s.id, case when s.id % 50 = 0 then concat(title, ', "the | second"') else title end as title, kind, owned, coalesce(g.genres, '') as genres from series s
    left join (select series_id, string_agg(genre, '; ' order by genre) as genres from series_genres group by series_id) g on g.series_id = s.id)"""


@query(f"""select id, concat(case when title like '%"%' or title like '%,%' then concat('"', replace(title, '"', '""'), '"') else title end, ',', kind, ',', owned, ',', genres) as line from {_EXPORTED}""")
def export_csv(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    rows = _export_rows(series, series_genres)
    return rows.select("id", export.csv_line(rows, export.selection(["owned", "kind", "nonsense", "genres"], ["title", "kind", "owned", "genres"])).alias("line"))


@query(f"""select id, concat('| ', replace(title, '|', '\\|'), ' | ', kind, ' | ', owned, ' | ', genres, ' |') as line from {_EXPORTED}""")
def export_markdown(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    rows = _export_rows(series, series_genres)
    return rows.select("id", export.markdown_line(rows, export.selection(None, ["title", "kind", "owned", "genres"])).alias("line"))


@query("""select id, concat('{"title":"', replace(title, '"', '\\"'), '","kind":"', kind, '","owned":', owned, '}') as line from """ + _EXPORTED)
def export_json(series: DataFrame, series_genres: DataFrame) -> DataFrame:
    rows = _export_rows(series, series_genres)
    return rows.select("id", export.json_line(export.selection(["owned", "kind"], ["title", "kind", "owned", "genres"])).alias("line"))
