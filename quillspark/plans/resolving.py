"""Entity resolution of synthetic releases against a catalog made of the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import aggregates as ag
from quillspark.operators import resolution
from quillspark.plans.registry import query
from quillspark.plans.text import _DICE, _grams


def _inputs(spark, part: DataFrame) -> dict[str, DataFrame]:
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("manga")).otherwise(F.lit("novel"))
    name = F.concat(F.col("p_name"), F.lit(" saga q"), F.col("p_partkey").cast("string"), F.lit("z"))
    catalog = part.select(F.col("p_partkey").alias("entry"), name.alias("title"), kind.alias("kind"))
    mapping = part.where("p_partkey % 5 = 0").select(F.lit("mal").alias("provider"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("external_id"), (F.col("p_partkey") * 10).alias("series_id"), kind.alias("kind"))
    foreign = part.select(F.lit("anilist").alias("provider"), F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("external_id"), F.col("p_partkey").alias("entry"))
    link = lambda p, v: F.struct(F.lit(p).alias("provider"), F.concat(F.lit(v), F.col("p_partkey").cast("string")).alias("id"))
    links = F.when(F.col("p_partkey") % 10 == 0, F.array(link("anilist", "a"), link("mal", "m"))).when(F.col("p_partkey") % 10 == 1, F.array(link("anilist", "a"))).when(F.col("p_partkey") % 10 == 2, F.array(link("mangaupdates-legacy", ""))).otherwise(F.array().cast("array<struct<provider:string,id:string>>"))
    title = F.when(F.col("p_partkey") % 10 == 9, F.concat(F.lit("nothing like it "), F.col("p_partkey").cast("string"), F.lit("k"))).otherwise(F.concat(name, F.lit(" v01-03 (2019) (Digital).cbz")))
    releases = part.select(F.col("p_partkey").alias("id"), title.alias("title"), F.array(F.lit("x.cbz")).alias("files"), links.alias("links"))
    id_map = part.where("p_partkey % 20 = 2").select(F.col("p_partkey").alias("legacy_id"), F.lit(None).cast("string").alias("modern_id"))
    return {"releases": releases, "mapping": mapping, "foreign": foreign, "catalog": catalog, "id_map": id_map}


#: The steps of the resolution over the same inputs, each from its own table.
_EXPECTED = f"""with entries as (select p_partkey as entry, concat(p_name, ' saga q', p_partkey, 'z') as title, case when p_partkey % 2 = 0 then 'manga' else 'novel' end as kind from part),
    mapped as (select 'mal' as provider, concat('m', p_partkey) as external_id, p_partkey * 10 as series_id, case when p_partkey % 2 = 0 then 'manga' else 'novel' end as kind from part where p_partkey % 5 = 0),
    listed as (select 'anilist' as provider, concat('a', p_partkey) as external_id, p_partkey as entry from part),
    asked as (select p_partkey as id, case when p_partkey % 10 = 9 then concat('nothing like it ', p_partkey, 'k') else concat(p_name, ' saga q', p_partkey, 'z v01-03 (2019) (Digital).cbz') end as title from part),
    links as (select p_partkey as id, 0 as pos, 'anilist' as provider, concat('a', p_partkey) as external_id from part where p_partkey % 10 in (0, 1) union all select p_partkey, 1, 'mal', concat('m', p_partkey) from part where p_partkey % 10 = 0),
    known as (select id, arg_min(series_id, pos) as series_id, arg_min(kind, pos) as kind from links join mapped using (provider, external_id) group by id),
    looked as (select id, arg_min(entry, pos) as entry from links join listed using (provider, external_id) where id not in (select id from known) group by id),
    cleaned as (select id, trim(regexp_replace(title, ' v01-03 \\(2019\\) \\(Digital\\)\\.cbz$', '')) as text from asked where id not in (select id from known) and id not in (select id from looked)),
    e as (select *, list_distinct(regexp_split_to_array(lower(title), '[^a-z0-9]+')) as t, {_grams("title")} as g from entries),
    c as (select *, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as t, {_grams("text")} as g from cleaned),
    hits as (select c.id, e.entry, e.kind, cast({_DICE.format(a="c.g", b="e.g")} as float) as score from c join e on list_contains(e.t, c.t[-1]) and len(list_intersect(c.t, e.t)) = len(c.t)),
    best as (select * from (select *, row_number() over (partition by id order by score desc, entry) as place from hits) where place = 1 and score >= 0.85::float),
    decided as (select id, 'known_external_id' as path, kind, null as entry, series_id from known union all select id, 'foreign_id_lookup', kind, entry, null from looked join entries using (entry) union all select id, 'fuzzy_title', kind, entry, null from best)
    select a.id, d.path, case when d.id is null then 'unresolved' when d.kind = 'novel' then 'ambiguous' else 'resolved' end as status, d.entry, d.series_id from asked a left join decided d using (id)"""


@query(_EXPECTED)
def resolve_releases(spark, part: DataFrame) -> DataFrame:
    outcomes, _ = resolution.resolve(**_inputs(spark, part))
    return outcomes.select("id", "path", "status", "entry", "series_id")


@query(f"""select count(*) filter (status = 'resolved' and path = 'known_external_id') as known_id, count(*) filter (status = 'resolved' and path = 'foreign_id_lookup') as foreign_id, count(*) filter (status = 'resolved' and path = 'fuzzy_title') as fuzzy,
    count(*) filter (status in ('review_pending', 'ambiguous')) as review, count(*) filter (status not in ('resolved', 'review_pending', 'ambiguous')) as failed from ({_EXPECTED})""")
def resolve_tally(spark, part: DataFrame) -> DataFrame:
    outcomes, _ = resolution.resolve(**_inputs(spark, part))
    return ag.outcome_tally(outcomes.select(F.col("path").alias("resolution_path"), F.col("status").alias("resolution_status")))


@query(f"""with outcome as ({_EXPECTED}), founded as (select entry, row_number() over (order by entry) + 10000000 as series_id from (select distinct entry from outcome where entry is not null))
    select o.id, o.path, o.status, coalesce(o.series_id, f.series_id)::bigint as series_id from outcome o left join founded f using (entry)""")
def resolved_to_series(spark, part: DataFrame) -> DataFrame:
    given = _inputs(spark, part)
    none = F.array().cast("array<struct<provider:string,id:string>>")
    series = spark.createDataFrame([(10_000_000, "Stored", "manual", 1)], "id bigint, title string, metadata_source string, updated_at bigint")
    catalog = given.pop("catalog").withColumn("foreign_ids", F.when(F.col("entry") % 10 == 3, F.array(F.struct(F.lit("anilist").alias("provider"), F.concat(F.lit("a"), F.col("entry").cast("string")).alias("id")))).otherwise(none))
    outcomes, _, _, _ = resolution.resolve_and_persist(series=series, catalog=catalog, provider="mangabaka", now=5, **given)
    return outcomes.select("id", "path", "status", "series_id")


@query("select id from releases where resolution_status in ('unresolved', 'ambiguous') and resolution_status not in ('rejected', 'standalone') and (resolution_path <> 'manual' or resolution_path is null)")
def open_releases(releases: DataFrame) -> DataFrame:
    return resolution.open_releases(releases, ["unresolved", "ambiguous"]).select("id")


@query(f"""with entries as (select p_partkey as entry, concat(p_name, ' saga q', p_partkey, 'z') as title, p_partkey % 2 = 0 as fits from part),
    e as (select *, list_distinct(regexp_split_to_array(title, '[^a-z0-9]+')) as t, {_grams("title")} as g from entries),
    asked as (select p_partkey as id, p_name as text, list_distinct(regexp_split_to_array(p_name, '[^a-z0-9]+')) as t, {_grams("p_name")} as g from part where p_partkey % 20 = 0),
    hits as (select a.id, e.entry, e.fits, cast({_DICE.format(a="a.g", b="e.g")} as float) as score from asked a join e on len(list_intersect(a.t, e.t)) = len(a.t)),
    best as (select * from (select *, row_number() over (partition by id order by score desc, entry) as rank from hits) where rank <= 10),
    usable as (select id, max(score) as top from (select *, bool_or(fits) over (partition by id) as any_fit from best) where fits or not any_fit group by id),
    low as (select b.*, row_number() over (partition by id order by score desc, entry) as place from best b join usable using (id) where score >= 0.55::float and top < 0.85::float)
    select id, entry, round(score::double, 5) as score from low where place <= 5""")
def review_candidates(spark, part: DataFrame) -> DataFrame:
    given = _inputs(spark, part)
    none = F.array().cast("array<struct<provider:string,id:string>>")
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.lit("x.cbz")).alias("files"), none.alias("links"))
    _, put_up = resolution.resolve(**given | {"releases": asked})
    return put_up.select("id", "entry", F.round(F.col("score").cast("double"), 5).alias("score"))
