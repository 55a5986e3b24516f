"""The catalog's tables as views on the engine's Parquet tables.

Each view is one SELECT that Spark and DuckDB both run, so a query and the SQL
that checks it start from the same rows.  ``epoch(...)`` stands for the epoch
seconds of a time in either dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.lineage import dealt

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings"]

VIEWS = {
    "runs": """
        select event_id as id, user_id as source, epoch(ts) as started_at,
               case event_type when 'purchase' then 'success' when 'view' then 'success' when 'error' then 'failure' when 'signup' then 'skipped' else 'running' end as status,
               case when event_type <> 'click' then epoch(ts) + event_id % 97 end as finished_at,
               case when event_id % 13 = 0 then null else event_id % 50 end as fetched,
               case when event_id % 17 = 0 then null else event_id % 7 end as added,
               case when event_type = 'error' and event_id % 5 <> 0 then concat('kind', event_id % 3) end as error_kind
        from events""",
    "series": """
        select p_partkey as id, p_name as title, p_type as alternate, p_brand as brand,
               case p_size % 6 when 0 then 'manga' when 1 then 'manhwa' when 2 then 'manhua' when 3 then 'novel' when 4 then 'one_shot' else 'oel' end as kind,
               case p_size % 5 when 0 then 'ongoing' when 1 then 'completed' when 2 then 'hiatus' when 3 then 'cancelled' end as status,
               1990 + p_size % 30 as year, case when p_partkey % 9 = 0 then null else p_retailprice end as rating,
               p_partkey % 4 = 0 as owned, case when p_partkey % 7 = 0 then 1700000000 + p_partkey end as wishlisted_at,
               case when p_size % 4 = 0 then 'manual' else 'provider' end as metadata_source,
               case when p_partkey % 5 = 0 then null else concat('h', p_partkey % 100) end as metadata_hash,
               1700000000 + (p_partkey * 37) % 5000 as fetched_at,
               case when p_partkey % 11 = 0 then 0 else 1700000000 + (p_partkey * 53) % 700 end as updated_at
        from part""",
    "releases": """
        select l_orderkey * 8 + l_linenumber as id, concat('feed', l_suppkey % 7) as source_name, concat('x', l_orderkey, '-', l_linenumber) as external_id,
               concat('https://feed.example/view/', l_orderkey * 8 + l_linenumber) as link,
               case when l_linenumber % 4 = 0 then null when l_partkey % 10 = 3 then l_partkey + 100000000 else l_partkey end as series_id,
               case when l_linenumber % 4 = 0 then case when l_returnflag = 'N' then 'unresolved' when l_returnflag = 'A' then 'ambiguous' else 'review_pending' end
                    when l_tax > 0.07 then 'rejected' when l_linestatus = 'F' then 'resolved' else 'standalone' end as resolution_status,
               case when l_tax > 0.07 then 'rejected' when l_linenumber % 3 = 0 then 'manual' when l_linenumber % 3 = 1 then 'known_external_id' when l_discount > 0.05 then 'fuzzy_title' end as resolution_path,
               l_linenumber % 3 as resolution_attempts, l_discount * 10 as resolution_confidence,
               epoch(l_shipdate) as posted_at, epoch(l_shipdate) + l_partkey % 1000 as observed_at,
               case when l_quantity > 25 then epoch(l_shipdate) + 5000 end as resolved_at,
               case when l_linenumber % 5 = 0 then null else 'a.cbz' end as files, case when l_quantity < 10 then null else 'text' end as description,
               l_linenumber as volume, l_partkey as partkey
        from lineitem""",
    "release_sources": """
        select l_orderkey * 8 + l_linenumber as release_id, concat('feed', l_suppkey % 7) as source_name from lineitem
        union select l_orderkey * 8 + l_linenumber as release_id, concat('feed', l_partkey % 7) as source_name from lineitem where l_linenumber % 2 = 0""",
    "release_formats": """
        select l_orderkey * 8 + l_linenumber as release_id, case l_partkey % 3 when 0 then 'cbz' when 1 then 'epub' else 'pdf' end as format from lineitem where l_linenumber % 5 <> 0""",
    "external_ids": """
        select 'anilist' as provider, concat('a', p_partkey % 1900) as external_id, p_partkey as series_id from part where p_size % 2 = 0
        union all select 'mal' as provider, concat('m', p_partkey) as external_id, p_partkey as series_id from part where p_size % 3 = 0""",
    "series_genres": """
        select p_partkey as series_id, p_brand as genre from part
        union select p_partkey as series_id, concat('Brand#', 11 + p_size % 5) as genre from part
        union select p_partkey as series_id, concat('Brand#', 21 + p_size % 3) as genre from part where p_partkey % 2 = 0""",
    "candidates": """
        select l_orderkey * 8 + l_linenumber as release_id, l_partkey % 40 as series_id, l_extendedprice % 1000 as score
        from lineitem where l_linenumber % 4 = 0""",
    "queue": """
        select doc_id as id, source, n_chars as score, lang, text from documents""",
    "library": """
        select p_partkey as series_id, case when p_partkey % 3 = 0 then null else p_size % 10 end as have_volume, case when p_size % 4 = 0 then null else p_size % 100 end as have_chapter,
               case when p_partkey % 6 = 0 then 'manual' else 'auto' end as link_kind, concat('u', p_partkey) as item
        from part where p_size % 3 <> 1""",
    "titles": """
        select p_partkey as id, p_name as base, concat(
                 case p_partkey % 4 when 0 then '[Group] ' when 1 then '' when 2 then '(C99) ' else '' end, p_name,
                 case p_partkey % 9
                   when 0 then concat(' v0', p_size % 9 + 1, '-1', p_size % 9)
                   when 1 then concat(' c', 100 + p_size, ' (2019) (Digital).cbz')
                   when 2 then concat(' Volumes ', p_size % 9 + 1, ' - ', p_size % 9 + 5)
                   when 3 then concat(' v001-11', p_size % 9, ' + 120-1', 30 + p_size)
                   when 4 then concat(' | Second ', p_type)
                   when 5 then concat(' - A Novel ', 100 + p_size)
                   when 6 then concat(' Chapter ', p_size, '.5 [C0045813].zip')
                   when 7 then concat(' / Other ', p_brand, ' 0', p_size)
                   else ' (Digital) (Raw)' end) as title
        from part""",
}


def used(sql: str) -> list[str]:
    """Views that a statement names, those they need themselves included (none do)."""
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; a plain table by its own name.

    The rows of a union are dealt before they are made distinct: they are so
    few bytes that adaptive execution, which goes by bytes, would give millions
    of them to one task.
    """
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"\bepoch\(([^()]+)\)", r"cast(unix_timestamp(cast(\1 as timestamp)) as bigint)", VIEWS[name])
    found = [t for t in TABLES if re.search(rf"\bfrom {t}\b", sql)]
    for t in found:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    every = re.sub(r"\bunion(?! all\b)", "union all", sql)
    rows = spark.sql(every, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in found})
    return rows if every == sql else dealt(rows, *rows.columns).distinct()


def duck_sql(sql: str) -> str:
    """DuckDB statement with the views it names as common table expressions."""
    parts = []
    for name in used(sql):
        body = re.sub(r"\bepoch\(([^()]+)\)", r"cast(floor(epoch(\1)) as bigint)", VIEWS[name])
        parts.append(f"{name} as materialized ({body})")
    if not parts:
        return sql
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {sql[15:]}"
    if sql.lower().startswith("with "):
        return f"with {', '.join(parts)}, {sql[5:]}"
    return f"with {', '.join(parts)} {sql}"
