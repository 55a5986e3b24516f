"""Queries on providers: lookups through the cache of misses, searches of all kinds, names, links, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import formats as fm
from quillspark.functions import ids, records, spans, titles
from quillspark.functions import values as va
from quillspark.operators import aggregates as ag
from quillspark.operators import merges, misses, paging
from quillspark.operators.lineage import dealt
from quillspark.plans.registry import query
from quillspark.sources import feeds
from quillspark.plans.text import _CHAPTERS, _DICE, _VOLUMES, _grams, _merged_sql, _q

NOW = 1_800_000_000
_CACHED = f"select 'mal' as provider, concat('c', c_custkey) as external_id, {NOW} - (c_custkey * 37) % 5000 as recorded_at from customer where c_custkey % 3 = 0"
_LOOKED_UP = f"""cached as ({_CACHED}), alive as (select * from cached where recorded_at > {NOW} - 2500),
    asked as (select 'mal' as provider, concat('c', c_custkey) as external_id, c_custkey % 4 = 0 as there from customer where c_custkey % 2 = 0),
    open as (select * from asked where external_id not in (select external_id from alive))"""


def _lookup(customer: DataFrame):
    key = [F.lit("mal").alias("provider"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("external_id")]
    cache = customer.where("c_custkey % 3 = 0").select(*key, (F.lit(NOW) - (F.col("c_custkey") * 37) % 5000).cast("bigint").alias("recorded_at"))
    wanted, known = customer.where("c_custkey % 2 = 0").select(*key), customer.where("c_custkey % 4 = 0").select(*key, F.col("c_name").alias("name"))
    return misses.lookup(wanted, known, cache, NOW, 2500, 60)


@query(f"with {_LOOKED_UP} select external_id, c_name as name from open join customer on concat('c', c_custkey) = external_id where there")
def lookups_past_misses(customer: DataFrame) -> DataFrame:
    return _lookup(customer)[0].select("external_id", "name")


@query(f"""with {_LOOKED_UP}, made as (select provider, external_id, recorded_at from alive where external_id not in (select external_id from open) union all select provider, external_id, {NOW} from open where not there)
    select provider, external_id, recorded_at::bigint as recorded_at from (select *, count(*) over () as n, row_number() over (order by recorded_at desc, provider, external_id) as place from made) where n <= 60 or place <= 30""")
def misses_recorded(customer: DataFrame) -> DataFrame:
    return _lookup(customer)[1]


_ASKED = """select p_partkey as query_id, case when p_partkey % 10 in (0, 1) then p_name end as q,
    case p_partkey % 10 when 1 then p_partkey::varchar when 2 then concat(' ', p_partkey, ' ') when 3 then concat('a', p_partkey) when 4 then concat('https://anilist.co/manga/a', p_partkey)
      when 5 then concat('https://mangabaka.dev/', p_partkey, '?x=1') when 6 then concat('https://www.mangaupdates.com/series.html?id=', p_partkey) when 7 then concat('https://anilist.co/manga/a', p_partkey, '/name') when 8 then '  ' end as external_id,
    case when p_partkey % 10 in (3, 7) then 'anilist' end as foreign_provider from part where p_partkey % 20 = 0 or p_partkey % 10 > 0"""


@query(f"""with asked as ({_ASKED}), g as (select p_partkey::varchar as id, {_grams("p_name")} as g, list_distinct(regexp_split_to_array(p_name, '[^a-z0-9]+')) as t from part),
    sure as (select query_id, query_id::varchar as id, 1.0::double as score, 1 as rank from asked where query_id % 10 in (1, 2, 5) union all select query_id, query_id::varchar, 1.0, 1 from asked where query_id % 10 in (3, 4, 7) and query_id % 3 <> 0),
    met as (select a.query_id, g.id, {_DICE.format(a="q.g", b="g.g")} as score from asked a join g q on q.id = a.query_id::varchar join g on len(list_intersect(q.t, g.t)) = len(q.t) where a.query_id % 10 = 0),
    ranked as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from met)
    select query_id, id, round(score, 5) as score, rank from sure union all select query_id, id, round(score, 5), rank from ranked where rank <= 25""")
def provider_answers(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    key = k.cast("string")
    at = k % 10
    given = F.when(at == 1, key).when(at == 2, F.concat(F.lit(" "), key, F.lit(" "))).when(at == 3, F.concat(F.lit("a"), key)).when(at == 4, F.concat(F.lit("https://anilist.co/manga/a"), key))
    given = given.when(at == 5, F.concat(F.lit("https://mangabaka.dev/"), key, F.lit("?x=1"))).when(at == 6, F.concat(F.lit("https://www.mangaupdates.com/series.html?id="), key)).when(at == 7, F.concat(F.lit("https://anilist.co/manga/a"), key, F.lit("/name"))).when(at == 8, F.lit("  "))
    asked = part.where("p_partkey % 20 = 0 or p_partkey % 10 > 0").select(k.alias("query_id"), F.when(at.isin(0, 1), F.col("p_name")).alias("q"), given.alias("external_id"), F.when(at.isin(3, 7), F.lit("anilist")).alias("foreign_provider"))
    dump = part.select(key.alias("id"), F.col("p_name").alias("title"))
    foreign = part.where("p_partkey % 3 <> 0").select(F.lit("anilist").alias("provider"), F.concat(F.lit("a"), key).alias("external_id"), key.alias("id"))
    out = misses.answered(asked, "mangabaka", dump, foreign)
    return out.select("query_id", "id", F.round(F.col("score").cast("double"), 5).alias("score"), "rank")


@query("""select s_suppkey as id, case s_suppkey % 6 when 0 then 'mal' when 1 then 'mangaupdates' when 2 then 'anilist' when 3 then 'mangabaka' when 4 then 'mal' end as provider from supplier""")
def library_sources(supplier: DataFrame) -> DataFrame:
    written = F.when(F.col("s_suppkey") % 6 == 0, "plugin:MyAnimeList").when(F.col("s_suppkey") % 6 == 1, " api: Manga_Updates").when(F.col("s_suppkey") % 6 == 2, "AniList").when(F.col("s_suppkey") % 6 == 3, "api:mangabaka").when(F.col("s_suppkey") % 6 == 4, "my_anime_list").otherwise("elsewhere")
    return supplier.select(F.col("s_suppkey").alias("id"), ids.source_name(written).alias("provider"))


@query("""select p_partkey as id, array_to_string(list_filter([case when p_partkey % 2 = 0 then concat('anilist=', p_partkey) end, case when p_partkey % 5 = 0 then concat('mangaupdates-legacy=', p_partkey) when p_partkey % 5 = 1 then concat('mangaupdates=s', p_partkey) end], lambda x: x is not null), ';') as pairs from part""")
def stored_link_pairs(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    links = {p: F.lit(None).cast("string") for p in ids.PROVIDERS}
    links["anilist"] = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://anilist.co/manga/"), key)).otherwise(F.lit("https://anilist.co/about/"))
    links["mangaupdates"] = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("https://www.mangaupdates.com/series.html?id="), key)).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("https://www.mangaupdates.com/series/s"), key, F.lit("/name")))
    pairs = ids.link_pairs(F.struct(*[c.alias(p) for p, c in links.items()]))
    named = F.array_sort(F.transform(pairs, lambda r: F.concat(r["provider"], F.lit("="), r["id"])))
    return part.select(F.col("p_partkey").alias("id"), F.array_join(named, ";").alias("pairs"))


@query("select p_partkey as id, p_partkey % 3 = 0 as audiobook from part")
def audiobook_hints(part: DataFrame) -> DataFrame:
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, " [AudioBook]").otherwise(" audiobooks v2")).when(F.col("p_partkey") % 3 == 1, "audiobook").otherwise(" audiobooked"))
    return part.select(F.col("p_partkey").alias("id"), (F.size(fm.title_hints(title)) == 1).alias("audiobook"))


@query("""select p_partkey as id, concat_ws(';', case when p_size % 2 = 0 then concat('anilist=', p_size) end, case when p_size % 3 <> 0 then concat('mal=', p_brand) end) as ids from part""")
def foreign_id_lists(part: DataFrame) -> DataFrame:
    found = va.foreign_ids({"anilist": F.when(F.col("p_size") % 2 == 0, F.col("p_size")), "mal": F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).otherwise("")})
    return part.select(F.col("p_partkey").alias("id"), F.array_join(F.transform(found, lambda x: F.concat(x["provider"], F.lit("="), x["id"])), ";").alias("ids"))


@query("select p_partkey as id, least(p_size, 12)::int as asked, greatest(p_size - 12, 0)::int as dropped from part")
def capped_query_sets(part: DataFrame) -> DataFrame:
    given = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat("p_name", F.lit(" "), i.cast("string")))
    made = titles.query_set(F.concat(given, F.transform(given, lambda t: F.upper(t))))
    return dealt(part, "p_partkey").select(F.col("p_partkey").alias("id"), F.size(made["queries"]).alias("asked"), made["dropped"].cast("int").alias("dropped"))


#: Units of sizes with their bytes.
_UNITS = [("B", 1), ("KB", 1000), ("KiB", 1024), ("MB", 1000**2), ("MiB", 1024**2), ("GB", 1000**3), ("GiB", 1024**3), ("TB", 1000**4), ("TiB", 1024**4)]


@query(f"""select p_partkey as id, case when p_partkey % 10 = 9 then null else p_size * (case p_partkey % 10 {" ".join(f"when {i} then {n}" for i, (_, n) in enumerate(_UNITS))} end)::bigint end as bytes from part""")
def sizes_of_all_units(part: DataFrame) -> DataFrame:
    unit = F.lit("furlongs")
    for i, (name, _) in enumerate(_UNITS):
        unit = F.when(F.col("p_partkey") % 10 == i, F.lit(name)).otherwise(unit)
    return part.select(F.col("p_partkey").alias("id"), va.parse_size(F.concat(F.col("p_size").cast("string"), F.lit(" "), unit)).alias("bytes"))


@query("""select id, kind <> 'novel' and id % 2 = 0 as broken, (id % 2 = 0)::int as fired, concat(title, case when id % 2 = 0 then '' else ' extra' end) as query from series""")
def configured_rules(series: DataFrame) -> DataFrame:
    rules = [(["scroll"], ["novel"])]
    found = F.when(F.col("id") % 2 == 0, F.array(F.lit("Scroll"), F.lit("pdf"))).otherwise(F.array(F.lit("pdf")))
    named = F.concat("title", F.when(F.col("id") % 2 == 0, " (Scroll) scroll").otherwise(" extra"))
    return series.select("id", F.coalesce(fm.mismatch(found, F.col("kind"), rules).isNotNull(), F.lit(False)).alias("broken"), F.size(fm.fired_rules(found, rules)).alias("fired"), titles.primary(titles.clean_title(named, ["scroll"])).alias("query"))


# --- spans of files ----------------------------------------------------------------

_FILE = "concat(base, case id % 5 when 0 then ' v02.cbz' when 1 then ' c010-012.cbz' when 2 then ' v1-3 c5.zip' when 3 then '/extras.txt' else ' v07 c31.5.cbz' end)"
_STEMS = f"select id, regexp_replace(unnest([{_FILE}, concat(base, ' v0', id % 7 + 1, '.cbz'), title]), {_q(spans.GROUPS)}, ' ', 'g') as stem from titles"
_FILE_SPANS = f"""stems as ({_STEMS}), {_merged_sql(_VOLUMES, "vol")}, {_merged_sql(_CHAPTERS, "cha")}"""


def _with_files(rows: DataFrame) -> DataFrame:
    return rows.withColumn("files", F.array(F.expr(_FILE), F.concat("base", F.lit(" v0"), (F.col("id") % 7 + 1).cast("string"), F.lit(".cbz"))))


def _text(column: str):
    return F.array_join(F.transform(column, spans.human), ";")


@query(f"with {_FILE_SPANS} select t.id, coalesce(vol.t, '') as volumes, coalesce(cha.t, '') as chapters from titles t left join vol on vol.id = t.id left join cha on cha.id = t.id")
def file_spans(titles: DataFrame) -> DataFrame:
    rows = _with_files(dealt(titles, "id")).select("id", spans.detect_spans(F.col("files"), F.col("title")).alias("s"))
    return rows.select("id", _text("s.volumes").alias("volumes"), _text("s.chapters").alias("chapters"))


@query(f"""with {_FILE_SPANS}, old as (select id, case when id % 3 = 0 then concat(id % 7 + 1) when id % 3 = 1 then null else coalesce((select t from vol where vol.id = titles.id), '') end as was, id % 3 = 2 as kept from titles),
    now as (select o.*, coalesce(vol.t, '') as v, coalesce(cha.t, '') as c from old o left join vol using (id) left join cha using (id))
    select count(*) as releases_read, count(*) filter (v <> coalesce(was, '') or (not kept and c <> '')) as releases_rewritten, (select count(distinct id % 50) from titles) as series_read, (select count(distinct id % 50) from titles where id % 50 % 2 = 0) as series_changed from now""")
def span_rewrite_counts(titles: DataFrame) -> DataFrame:
    rows = _with_files(dealt(titles, "id"))
    now = spans.detect_spans(F.col("files"), F.col("title"))
    one = F.array(F.struct((F.col("id") % 7 + 1).cast("double").alias("start"), (F.col("id") % 7 + 1).cast("double").alias("end")))
    kind = F.col("id") % 3
    rows = rows.withColumn("_now", now).withColumn("volume_span", F.when(kind == 0, one.cast(spans.SPANS)).when(kind == 2, F.col("_now.volumes"))).withColumn("chapter_span", F.when(kind == 2, F.when(F.size("_now.chapters") > 0, F.col("_now.chapters")))).drop("_now")
    made = ag.rewritten_spans(rows)
    linked = made.select(F.expr("id % 50").alias("series_id"), "volume_span", "chapter_span", F.lit(5).cast("bigint").alias("observed_at"), F.lit(6).cast("bigint").alias("posted_at"))
    cover = ag.coverage(linked)
    none = F.lit(None).cast(spans.SPANS)
    stored = cover.select(F.col("series_id").alias("id"), F.when(F.col("series_id") % 2 == 1, F.col("volumes")).otherwise(none).alias("volumes"), F.col("chapters"), F.lit(1).cast("bigint").alias("updated_at"))
    return ag.rewrite_counts(made, ag.recompute_coverage(stored, linked, NOW))


_BODY = """case when p_partkey % 6 = 0 then concat('{"data":{"id":', p_partkey, ',"title":"', p_name, '","type":"manga","final_volume":"', p_size, '"}}')
    when p_partkey % 6 = 1 then concat('{"id":', p_partkey, ',"title":"', p_name, '","type":"novel"}') when p_partkey % 6 = 2 then concat('{"data":[{"id":', p_partkey, ',"title":"', p_name, '"},{"id":', p_partkey + 1000000, ',"title":"second"},{"title":"none"}]}')
    when p_partkey % 6 = 3 then '{"data":null}' when p_partkey % 6 = 4 then 'gateway' else concat('{"id":', p_partkey, ',"title":"', p_name, '"}') end"""


@query(f"""with r as (select p_partkey as k, {_BODY} as body from part where p_partkey % 6 in (0, 1, 2))
    select (body::json ->> '$.data.id') as external_id, (body::json ->> '$.data.title') as canonical_title, (body::json ->> '$.data.final_volume')::int as total_volumes from r where k % 6 = 0
    union all select body::json ->> '$.id', body::json ->> '$.title', null from r where k % 6 = 1
    union all select body::json ->> '$.data[0].id', body::json ->> '$.data[0].title', null from r where k % 6 = 2 union all select body::json ->> '$.data[1].id', body::json ->> '$.data[1].title', null from r where k % 6 = 2""")
def client_answers(part: DataFrame) -> DataFrame:
    responses = part.select(F.when(F.col("p_partkey") % 6 == 5, 404).otherwise(200).alias("status"), F.expr(_BODY).alias("body"))
    return feeds.answers_of(responses).select("external_id", "canonical_title", "total_volumes")


# --- rows and records --------------------------------------------------------------


@query("""select id, source_name, case when id % 3 = 0 then null else concat('["a ', id, '.cbz","b.cbz"]') end as files_json, case when id % 4 <> 0 then concat('[{"start":', id % 9 + 1, '.0,"end":', id % 9 + 2, '.5}]') end as volume_span_json from releases""")
def records_round_trip(releases: DataFrame) -> DataFrame:
    key = F.col("id").cast("string")
    files = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "[]").otherwise("no list")).otherwise(F.concat(F.lit('["a '), key, F.lit('.cbz", "b.cbz"]')))
    span = F.when(F.col("id") % 4 != 0, F.concat(F.lit('[{"start":'), (F.col("id") % 9 + 1).cast("string"), F.lit(',"end":'), (F.col("id") % 9 + 2).cast("string"), F.lit(".5}]")))
    rows = releases.select("id", "source_name", files.alias("files_json"), span.alias("volume_span_json"))
    return records.to_row(records.to_record(rows))


@query("select id, title, case when id % 2 = 0 then owned end as owned, case when id % 2 = 0 then wishlisted_at end as wishlisted_at from series")
def admin_columns(series: DataFrame) -> DataFrame:
    return records.gated(series.select("id", "title", "owned", "wishlisted_at"), ["owned", "wishlisted_at"], F.col("id") % 2 == 0)


@query("select id, concat(title, ' ', alternate, ' ', brand) as text from series where id % 4 <> 0 union all select id, title from series where id % 4 = 0")
def index_texts(series: DataFrame) -> DataFrame:
    given = F.when(F.col("id") % 4 != 0, F.concat(F.lit('["'), "alternate", F.lit('","'), "brand", F.lit('"]')))
    return series.select("id", F.array_join(F.concat(F.array("title"), records.list_of(given, "array<string>")), " ").alias("text"))


@query("""select id, title, total, rank from (select id, title, count(*) over () as total, row_number() over (order by rating desc nulls last, id)::int as rank from series where kind = 'manga') where rank between 21 and 30""")
def page_with_total(series: DataFrame) -> DataFrame:
    rows = series.where("kind = 'manga'").select("id", "rating", "title")
    return paging.ranked_page(rows, [paging.nulls_last("rating"), F.col("id")], 3, 10).select("id", "title", "total", "rank")


@query("""select s_suppkey as source, case when s_suppkey % 2 = 0 then 'new' else 'old' end as etag, case when s_suppkey % 2 = 0 then 9 else 1 end::bigint as polled_at from supplier where s_suppkey % 5 <> 0 or s_suppkey % 2 = 0""")
def source_states(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey").alias("source")
    stored = supplier.where("s_suppkey % 5 <> 0").select(key, F.lit("old").alias("etag"), F.lit(1).cast("bigint").alias("polled_at"))
    coming = supplier.where("s_suppkey % 2 = 0").select(key, F.lit("new").alias("etag"), F.lit(9).cast("bigint").alias("polled_at"))
    return merges.upsert(stored, coming, ["source"], ["etag", "polled_at"])
