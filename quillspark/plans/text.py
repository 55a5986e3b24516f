"""Queries on text: spans, cleaned titles, similarity, search, links, formats, values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import formats as fm
from quillspark.functions import ids, spans, titles
from quillspark.functions import values as va
from quillspark.functions.similarity import best_dice, dice
from quillspark.operators import aggregates as ag
from quillspark.operators import joins, search, text_index
from quillspark.operators.lineage import dealt, shared_path
from quillspark.plans.registry import query
from quillspark.sources import feeds, walks
from quillspark.sources import pages as pages_


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# --- spans -------------------------------------------------------------------


def _found_sql(pattern: str, groups: int) -> str:
    """Spans of one pattern as a list of structs, in DuckDB."""
    caught = [f"regexp_extract_all(stem, {_q(pattern)}, {g})" for g in range(1, groups + 1)]
    numbers = ", ".join(f"try_cast(nullif({c}[i], '') as double)" for c in caught)
    return f"list_transform(range(1, len({caught[0]}) + 1), lambda i: {{'s': least({numbers}), 'e': greatest({numbers})}})"


_VOLUMES = f"list_concat({_found_sql(spans.VOLUME, 3)}, {_found_sql(spans.VOLUME_WORD, 2)})"
_CHAPTERS = f"list_concat({_found_sql(spans.CHAPTER, 3)}, {_found_sql(spans.PLUS, 2)})"


def _merged_sql(found: str, name: str) -> str:
    """Gaps and islands over the spans of each title."""
    return f"""
    {name}_f as (select id, unnest(x).s as s, unnest(x).e as e from (select id, {found} as x from stems)),
    {name}_m as (select *, case when s > max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as gap from {name}_f),
    {name}_i as (select *, sum(gap) over (partition by id order by s, e rows unbounded preceding) as island from {name}_m),
    {name}_r as (select id, min(s) as s, max(e) as e from {name}_i group by id, island),
    {name} as (select id, string_agg(concat(case when s = e then '' else concat(case when s = floor(s) then s::bigint::varchar else s::varchar end, '-') end, case when e = floor(e) then e::bigint::varchar else e::varchar end), ';' order by s) as t, max(e) as top from {name}_r group by id)"""


@query(f"""with stems as (select id, regexp_replace(title, {_q(spans.GROUPS)}, ' ', 'g') as stem from titles), {_merged_sql(_VOLUMES, "vol")}, {_merged_sql(_CHAPTERS, "cha")}
    select t.id, coalesce(vol.t, '') as volumes, coalesce(cha.t, '') as chapters, vol.top as highest_volume from titles t left join vol on vol.id = t.id left join cha on cha.id = t.id""")
def title_spans(titles: DataFrame) -> DataFrame:
    rows = dealt(titles, "id").select("id", spans.detect_spans(F.lit(None).cast("array<string>"), F.col("title")).alias("s"))
    text = lambda c: F.array_join(F.transform(c, spans.human), ";")
    return rows.select("id", text("s.volumes").alias("volumes"), text("s.chapters").alias("chapters"), spans.max_end(F.col("s.volumes")).alias("highest_volume"))


@query(f"""with stems as (select id % 97 as id, regexp_replace(title, {_q(spans.GROUPS)}, ' ', 'g') as stem from titles), {_merged_sql(_VOLUMES, "vol")}, {_merged_sql(_CHAPTERS, "cha")}
    select t.id as series_id, coalesce(vol.t, '') as volumes, coalesce(cha.t, '') as chapters, vol.top as highest_volume, cha.top as highest_chapter
    from (select distinct id % 97 as id from titles) t left join vol on vol.id = t.id left join cha on cha.id = t.id""")
def coverage_without_spans(titles: DataFrame) -> DataFrame:
    none = F.lit(None).cast(spans.SPANS)
    rows = dealt(titles, "id").select((F.col("id") % 97).alias("series_id"), "title", F.lit(None).cast("array<string>").alias("files"), none.alias("volume_span"), none.alias("chapter_span"), F.col("id").alias("observed_at"), F.col("id").alias("posted_at"))
    out = ag.coverage(ag.with_derived_spans(rows))
    text = lambda c: F.array_join(F.transform(c, spans.human), ";")
    return out.select("series_id", text("volumes").alias("volumes"), text("chapters").alias("chapters"), "highest_volume", "highest_chapter")


@query("""select id, case when id % 4 = 0 then 2 when id % 4 = 1 then 1 else 0 end as n, case when id % 4 < 2 then (id % 50)::double + 3 end as top from series""")
def spans_from_json(series: DataFrame) -> DataFrame:
    n = F.col("id") % 50
    two = F.format_string('[{"start":1.0,"end":2.0},{"start":%d.0,"end":%d.0}]', n, n + 3)
    one = F.format_string('{"start":%d.0,"end":%d.0}', n, n + 3)
    text = F.when(F.col("id") % 4 == 0, two).when(F.col("id") % 4 == 1, one).when(F.col("id") % 4 == 2, F.lit("garbage"))
    rows = series.select("id", spans.from_json(text).alias("s"))
    return rows.select("id", F.size("s").alias("n"), F.when(F.size("s") > 0, spans.max_end(F.col("s"))).alias("top"))


# --- titles ------------------------------------------------------------------


def _strip_sql() -> str:
    text = "title"
    for _, pattern in titles.strip_rules():
        text = f"regexp_replace({text}, {_q(pattern)}, ' ', 'g')"
    return text


_SQUEEZE = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^[\s\-,_/|+]+|[\s\-,_/|+]+$', '', 'g')"


@query(f"""with stripped as (select id, {_strip_sql()} as s from titles),
    halves as (select id, list_filter(list_transform(case when contains(s, '|') or contains(s, ' / ') then regexp_split_to_array(s, {_q(titles.ALTERNATES)}) else [s] end, lambda x: {_SQUEEZE.format(x="x")}), lambda x: x <> '') as h from stripped),
    heads as (select id, h, list_filter(list_transform(list_filter(h, lambda x: contains(x, ' - ')), lambda x: trim(split_part(x, ' - ', 1))), lambda x: len(x) >= 2) as k from halves),
    mixed as (select id, h, list_filter(k, lambda x, i: list_position(k, x) = i and not list_contains(h, x)) as k from heads),
    cut as (select id, h, k, list_filter(list_transform(list_filter(list_concat(h, k), lambda x: regexp_matches(x, {_q(titles.CHAPTER_SUFFIX)})), lambda x: trim(regexp_replace(x, {_q(titles.CHAPTER_SUFFIX)}, ''))), lambda x: len(x) >= 2) as c from mixed),
    every as (select id, len(h) as n, list_concat(h, k, list_filter(c, lambda x, i: list_position(c, x) = i and not list_contains(list_concat(h, k), x))) as q from cut),
    known as (select e.id, n, case when len(q) = 0 then [t.title] else q end as q, len(q) as found from every e join titles t on t.id = e.id),
    placed as (select id, n, found, list_sort(list_transform(q, lambda x, i: {{'size': -strlen(x), 'place': i, 'text': x}})) as q from known)
    select id, array_to_string(list_transform(q, lambda x: concat(x.text, '@', case when x.place <= n or found = 0 then '1.0' else '0.9' end)), '#') as queries, found::int as n_queries from placed""")
def cleaned_titles(titles: DataFrame) -> DataFrame:
    from quillspark.functions.titles import clean_title

    rows = dealt(titles, "id").select("id", clean_title(F.col("title")).alias("c"))
    texts = F.transform("c.queries", lambda q: F.concat(q["text"], F.lit("@"), F.format_string("%.1f", q["weight"])))
    empty = F.array_contains("c.rules", "empty_fallback")
    return rows.select("id", F.array_join(texts, "#").alias("queries"), F.when(empty, 0).otherwise(F.size(texts)).alias("n_queries"))


@query(r"""with g as (select id, [base, upper(base), 'ab', case when contains(base, ' ') then concat(base, '  x') end, 'éa', 'é', title, concat(base, ' 1'), concat(base, ' 2'), concat(base, ' 3'), concat(base, ' 4'), concat(base, ' 5'), concat(base, ' 6'), concat(base, ' 7'), concat(base, ' 8')] as l from titles),
    n as (select id, list_transform(list_filter(l, lambda t: t is not null), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))) as l from g),
    k as (select id, list_filter(l, lambda t: len(t) >= case when strlen(t) = len(t) then 3 else 2 end) as l from n),
    w as (select id, l, list_transform(l, lambda t: lower(t)) as low from k),
    u as (select id, list_filter(l, lambda t, i: list_position(low, lower(t)) = i) as l from w)
    select id, array_to_string(l[1:12], '#') as queries, greatest(len(l) - 12, 0)::int as dropped from u""")
def search_query_set(titles: DataFrame) -> DataFrame:
    from quillspark.functions.titles import query_set

    numbered = [F.concat("base", F.lit(f" {i}")) for i in range(1, 9)]
    several = F.array(F.col("base"), F.upper("base"), F.lit("ab"), F.when(F.contains("base", F.lit(" ")), F.concat(F.col("base"), F.lit("  x"))), F.lit("éa"), F.lit("é"), F.col("title"), *numbered)
    return dealt(titles, "id").select("id", query_set(several).alias("s")).select("id", F.array_join("s.queries", "#").alias("queries"), "s.dropped")


# --- similarity and search ----------------------------------------------------

_DICE = """case when len({a}) + len({b}) = 0 then 1.0 else 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end"""
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({x}), 1)), lambda i: substr({x}, i, 2)))"
_FOLD = r"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"


def _grams(x: str) -> str:
    return _GRAMS.format(x=_FOLD.format(x=x))


@query(f"select id, round({_DICE.format(a=_grams('title'), b=_grams('base'))}, 5) as score from titles")
def title_dice(titles: DataFrame) -> DataFrame:
    return dealt(titles, "id").select("id", F.round(dice(F.col("title"), F.col("base")).cast("double"), 5).alias("score"))


@query(f"""with g as (select id, title, {_grams("title")} as g from series),
    p as (select a.id as left_id, b.id as right_id, {_DICE.format(a="a.g", b="b.g")} as score from g a join g b on a.id % 20 = 0)
    select left_id, right_id, round(score, 5) as score from p where score >= 0.8""")
def similar_title_pairs(series: DataFrame) -> DataFrame:
    return joins.similar_title_rows(series.where("id % 20 = 0"), series, 0.8, digits=5)


@query("""select id, min(id) over (partition by regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) as class_id from series""")
def title_members(series: DataFrame) -> DataFrame:
    return joins.title_members(series)


@query(f"""with q as (select {_grams("'cold widget'")} as g),
    r as (select id, title, regexp_split_to_array(lower(title || ' ' || alternate), '[^a-z0-9]+') as tok, greatest({_DICE.format(a="q.g", b=_grams("title"))}, {_DICE.format(a="q.g", b=_grams("alternate"))}) as d from series, q),
    s as (select id, list_contains(tok, 'cold') and len(list_filter(tok, lambda t: starts_with(t, 'widget'))) > 0 as hit, d from r)
    select id, hit, round(d + case when hit then 0.5 else 0 end, 4) as score from s where hit or d >= 0.3""")
def catalog_search(series: DataFrame) -> DataFrame:
    rows = dealt(series, "id").select("id", "title", F.array("alternate").alias("alternates"), F.lit(None).cast("string").alias("description"), F.col("updated_at").alias("last_release_at"))
    out = search.catalog_search(rows, "Cold widget", "cold widget")
    return out.select("id", "hit", F.round(F.col("score").cast("double"), 4).alias("score"))


#: Tokens of a text without combining marks, as the index has them.
_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""select id from (select id, {_TOKENS.format(x="text")} as t from queue)
    where list_contains(t, 'the') and len(list_filter(t, lambda x: starts_with(x, 'wh'))) > 0""")
def text_search_prefix(queue: DataFrame) -> DataFrame:
    return queue.where(search.text_match(search.tokens(F.col("text")), "Thé wh")).select("id")


@query(f"""select id from queue where contains(' ' || array_to_string({_TOKENS.format(x="text")}, ' ') || ' ', ' of the ')""")
def text_search_phrase(queue: DataFrame) -> DataFrame:
    return queue.where(search.phrase_match(search.tokens(F.col("text")), "of-the")).select("id")


#: Titles of which two thirds have letters with marks that the query lacks, or the other way round.
_ACCENTED = "case when id % 3 = 0 then replace(replace(title, 'o', 'ộ'), 'd', 'ḍ') when id % 3 = 1 then replace(replace(title, 'l', 'ľ'), 'e', 'ě') else title end"


@query(f"""select id from (select id, {_TOKENS.format(x=_ACCENTED)} as t from series) where list_contains(t, 'cold') and len(list_filter(t, lambda x: starts_with(x, 'wid'))) > 0""")
def text_search_accents(series: DataFrame) -> DataFrame:
    return series.where(search.text_match(search.tokens(F.expr(_ACCENTED)), "Cǒld Ẅịd")).select("id")


@query(f"""with q as (select {_grams("'cold widget'")} as g),
    r as (select id, title, updated_at, {_TOKENS.format(x="title || ' ' || alternate")} as tok, greatest({_DICE.format(a="q.g", b=_grams("title"))}, {_DICE.format(a="q.g", b=_grams("alternate"))}) as d from series, q),
    s as (select id, title, updated_at, list_contains(tok, 'cold') and len(list_filter(tok, lambda t: starts_with(t, 'widget'))) > 0 as hit, d from r),
    o as (select id, title, row_number() over (order by (d + case when hit then 0.5 else 0 end)::float desc, updated_at desc nulls last, id)::int as rank from s where hit or d::float >= 0.3::float)
    select id, title, rank from o where rank between 21 and 40""")
def catalog_search_page(series: DataFrame) -> DataFrame:
    rows = dealt(series, "id").select("id", "title", F.array("alternate").alias("alternates"), F.lit(None).cast("string").alias("description"), F.col("updated_at").alias("last_release_at"))
    found = search.catalog_search(rows, "Cold widget", "cold widget")
    return search.search_page(found, series, 2, 20).select("id", "title", "rank")


@query(f"""with q as (select {_grams("'cold widget'")} as g),
    r as (select id, title, kind, year, updated_at, {_TOKENS.format(x="title || ' ' || alternate")} as tok, greatest({_DICE.format(a="q.g", b=_grams("title"))}, {_DICE.format(a="q.g", b=_grams("alternate"))}) as d from series, q),
    s as (select *, list_contains(tok, 'cold') and len(list_filter(tok, lambda t: starts_with(t, 'widget'))) > 0 as hit from r where kind in ('manga', 'novel') and year >= 2000),
    o as (select id, title, count(*) over () as total, row_number() over (order by (d + case when hit then 0.5 else 0 end)::float desc, updated_at desc nulls last, id)::int as rank from s where hit or d::float >= 0.3::float)
    select id, title, rank, total from o where rank between 6 and 10""")
def filtered_search_page(series: DataFrame) -> DataFrame:
    rows = dealt(series, "id").select("id", "title", F.array("alternate").alias("alternates"), F.lit(None).cast("string").alias("description"), F.col("updated_at").alias("last_release_at"))
    found = search.catalog_search(rows, "Cold widget", "cold widget")
    allowed = series.where(F.col("kind").isin("manga", "novel") & (F.col("year") >= 2000))
    return search.search_page(found, series, 2, 5, allowed).select("id", "title", "rank", "total")


_BM25 = """with t as (select id, title, tokens as t from (select id, title, {tokens} as tokens from series)),
    f as (select id, title, len(t) as n, len(list_filter(t, lambda x: x = 'cold')) as a, len(list_filter(t, lambda x: x = 'widget')) as b from t),
    e as (select count(*) as n, avg(n) as mean, count_if(a > 0) as da, count_if(b > 0) as db from f),
    s as (select f.id, f.title, greatest(ln((e.n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / mean)) + greatest(ln((e.n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / mean)) as score from f, e where a > 0 and b > 0)""".format(tokens=_TOKENS.format(x="title"))


@query(f"{_BM25} select id, round(score, 5) as rank_score from s order by score desc, id limit 2000")
def relevance_pool(series: DataFrame) -> DataFrame:
    return search.relevance(series.select("id", "title"), "title", "cold Widget").select("id", F.round("rank_score", 5).alias("rank_score"))


@query(f"{_BM25} select id, round(score, 5) as rank_score from s order by score desc, id limit 2000")
def indexed_relevance(spark, series: DataFrame) -> DataFrame:
    path = shared_path(spark, "index")
    text_index.build(series, "id", "title", path)
    return text_index.ranked(spark, path, "cold Widget").select("id", F.round("rank_score", 5).alias("rank_score"))


@query(f"""select id, (len(' ' || array_to_string({_TOKENS.format(x="text")}, '  ') || ' ') - len(replace(' ' || array_to_string({_TOKENS.format(x="text")}, '  ') || ' ', ' of  the ', ''))) // 9 as times
    from queue where contains(' ' || array_to_string({_TOKENS.format(x="text")}, '  ') || ' ', ' of  the ')""")
def indexed_phrase(spark, queue: DataFrame) -> DataFrame:
    path = shared_path(spark, "index")
    text_index.build(queue, "id", "text", path)
    return text_index.phrase(spark, path, ["of", "the"]).select("id", F.col("times").cast("bigint").alias("times"))


@query(f"""{_BM25}, p as (select id, title from s order by score desc, id limit 2000), q as (select {_grams("'cold Widget'")} as g), d as (select id, {_DICE.format(a="q.g", b=_grams("title"))} as d from p, q)
    select id, round(d, 5) as dice from d order by d desc, id limit 10""")
def fuzzy_candidates(series: DataFrame) -> DataFrame:
    return search.fuzzy_candidates(series.select("id", "title"), "title", "cold Widget", 10).select("id", F.round(F.col("dice").cast("double"), 5).alias("dice"))


@query("""with w as (select id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '')) as t from series),
    q as (select item_id as query_id, list_distinct(list_filter(regexp_split_to_array(lower(a || ' ' || b), '[^a-z0-9]+'), lambda x: x <> '')) as t from (select s.id as item_id, split_part(title, ' ', 1) as a, split_part(title, ' ', 2) as b from series s where s.id % 20 = 0))
    select query_id, w.id from q join w on len(list_intersect(q.t, w.t)) = len(q.t)""")
def search_candidates(series: DataFrame) -> DataFrame:
    asked = series.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", F.get(F.split("title", " "), F.lit(0)), F.get(F.split("title", " "), F.lit(1))).alias("text"))
    return search.candidate_pairs(asked, series, "id", "title")


@query(f"""with q as (select {_grams("'small ring'")} as g), r as (select id, {_DICE.format(a="q.g", b=_grams("title"))} as d from series, q)
    select id, round(d, 5) as score from r order by d desc, id limit 100""")
def provider_search(series: DataFrame) -> DataFrame:
    rows = dealt(series, "id").select("id", best_dice(F.lit("small ring"), F.array("title")).alias("d")).orderBy(F.col("d").desc(), "id").limit(100)
    return rows.select("id", F.round(F.col("d").cast("double"), 5).alias("score"))


# --- links and ids -------------------------------------------------------------


@query(r"""select page_id, len(h)::int as n, coalesce(h[1], '') as first_href, coalesce(h[-1], '') as last_href from (select page_id, regexp_extract_all(html, 'href\s*=\s*["'']([^"'']+)["'']', 1) as h from pages)""")
def page_hrefs(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.regexp_extract_all("html", F.lit(ids.HREF), F.lit(1)).alias("h"))
    return rows.select("page_id", F.size("h").alias("n"), F.coalesce(F.get("h", F.lit(0)), F.lit("")).alias("first_href"), F.coalesce(F.try_element_at("h", F.lit(-1)), F.lit("")).alias("last_href"))


@query(r"select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as path from pages")
def page_address(pages: DataFrame) -> DataFrame:
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    return pages.select("page_id", F.coalesce(F.parse_url("url", F.lit("AUTHORITY")), F.lit("")).alias("host"), path.alias("path"))


_LISTING = """concat('<table class="torrent-list"><tbody><tr><td><a href="/view/', p_partkey, '" title="', p_name, ' &amp; more">x</a></td><td class="text-center"><a href="/download/', p_partkey, '.torrent">t</a><a href="magnet:?xt=urn:btih:',
    upper(md5(p_name)), '&amp;dn=x">m</a></td><td class="text-center">', p_size, ' KiB</td>', case when p_partkey % 7 = 0 then '' else concat('<td data-timestamp="', 1700000000 + p_partkey, '"></td>') end, '</tr></tbody></table>')"""


@query(rf"""with listed as (select {_LISTING} as html from part)
    select regexp_extract(html, '/view/(\d+)"', 1) as external_id, replace(regexp_extract(html, 'title="([^"]*)"', 1), '&amp;', '&') as title, 'https://feed.example' || regexp_extract(html, 'href="(/view/\d+)"', 1) as link,
      lower(regexp_extract(html, 'btih:([0-9A-Fa-f]+)', 1)) as info_hash, 'https://feed.example' || regexp_extract(html, 'href="(/download/[^"]+)"', 1) as torrent_url,
      regexp_extract(html, '>(\d+) KiB<', 1)::bigint * 1024 as size_bytes, regexp_extract(html, 'data-timestamp="(\d+)"', 1)::bigint as posted from listed where html like '%data-timestamp="%'""")
def listing_rows(part: DataFrame) -> DataFrame:
    rows = pages_.parse_listing(dealt(part, "p_partkey").select(F.expr(_LISTING).alias("html")), "feed", "https://feed.example")
    return rows.select("external_id", "title", "link", "info_hash", "torrent_url", "size_bytes", F.unix_timestamp("posted_at").alias("posted"))


_DETAIL = """concat('<h3 class="panel-title"> ', p_name, '</h3><div class="col-md-1">File size:</div><div>', p_size, ' MB</div>', case when p_partkey % 5 = 0 then '' else concat('<div class="col-md-1">Info hash:</div><div><kbd>', upper(md5(p_name)), '</kbd></div>') end,
    '<div id="torrent-description">', p_type, ' https://anilist.co/manga/', p_partkey, '</div><div class="torrent-file-list"><ul><li><a class="folder">d</a><ul><li>', p_brand, '.cbz<span>1</span></li></ul></li></ul></div><div id="comments">https://myanimelist.net/manga/', p_size, '</div>')"""


@query(rf"""with shown as (select p_partkey as id, {_DETAIL} as html from part), parts as (select *, regexp_extract(html, 'torrent-description">([^<]*)<', 1) as description, regexp_extract(html, 'id="comments">([^<]*)<', 1) as comments from shown)
    select id, trim(regexp_extract(html, '<h3 class="panel-title">([^<]*)<', 1)) as title, lower(regexp_extract(html, '<kbd>([^<]*)<', 1)) as info_hash, regexp_extract(html, '>(\d+) MB<', 1)::bigint * 1000000 as size_bytes,
      regexp_extract(html, '<li>([^<>]+)<span>', 1) as files, description as description_html, regexp_extract(description, 'https://anilist\S+', 0) as own, regexp_extract(comments, 'https://myanimelist\S+', 0) as suggested
    from parts where html like '%<kbd>%'""")
def detail_pages(part: DataFrame) -> DataFrame:
    rows = pages_.parse_detail(dealt(part, "p_partkey").select(F.col("p_partkey").alias("id"), F.expr(_DETAIL).alias("html")), "https://feed.example")
    return rows.select("id", "title", "info_hash", "size_bytes", F.array_join("files", ";").alias("files"), "description_html", F.col("external_links.anilist").alias("own"), F.col("comment_suggested_links.mal").alias("suggested"))


_ITEM = """concat('<item><title><![CDATA[', p_name, ' <b>]]></title><link>https://feed.example/download/', p_partkey, '.torrent</link><guid>https://feed.example/view/', p_partkey, '</guid><pubDate>', case when p_partkey % 6 = 0 then 'never' else concat('Tue, 02 Jan 2024 ', case when p_partkey % 24 < 10 then '0' else '' end, p_partkey % 24, ':04:05 -0', p_partkey % 5, '00') end,
    '</pubDate><x:size>', p_size, ' GiB</x:size><x:infoHash>', upper(md5(p_name)), '</x:infoHash></item>')"""


@query(rf"""with items as (select {_ITEM} as x from part), fields as (select x, regexp_extract(x, '<pubDate>(.*?)</pubDate>', 1) as said from items)
    select regexp_extract(x, '/view/(\d+)</guid>', 1) as external_id, regexp_extract(x, 'CDATA\[(.*?)\]\]>', 1) as title, regexp_extract(x, '<x:size>(\d+) GiB', 1)::bigint * 1073741824 as size_bytes, lower(regexp_extract(x, '<x:infoHash>(\w+)<', 1)) as info_hash,
      regexp_extract(x, '<link>(.*?)</link>', 1) as torrent_url, epoch(strptime(said, '%a, %d %b %Y %H:%M:%S %z'))::bigint as posted from fields where said <> 'never'""")
def feed_items(part: DataFrame) -> DataFrame:
    bodies = part.groupBy((F.col("p_partkey") % 50).alias("feed")).agg(F.array_join(F.collect_list(F.expr(_ITEM)), "").alias("items"))
    items = feeds.items_of(bodies.select(F.concat(F.lit("<rss><channel>"), F.col("items"), F.lit("</channel></rss>")).alias("body")))
    return feeds.releases_of(items, "feed").select("external_id", "title", "size_bytes", "info_hash", "torrent_url", F.unix_timestamp("posted_at").alias("posted"))


#: Pages of a walk: query q, page p; some pages are empty and some failed.
_WALK = "select p_partkey as id, p_name as name, p_size % 4 as query, 1 + p_partkey % 30 as page, (p_size % 4 * 11 + 1 + p_partkey % 30) % 27 = 0 as void, (p_size % 4 * 5 + 1 + p_partkey % 30) % 29 = 0 as failed from part"


def _walk_pages(spark, part: DataFrame) -> DataFrame:
    rows = spark.sql(_WALK.replace("from part", "from {part}"), part=part)
    row = F.expr("""concat('<tr><td><a href="/view/', id % 700, '" title="', name, '">x</a></td><td data-timestamp="', 1700000000 + id % 700, '"></td></tr>')""")
    body = F.concat(F.lit('<table class="torrent-list"><tbody>'), F.array_join(F.collect_list(F.when(~F.col("void"), row)), ""), F.lit("</tbody></table>"))
    return rows.groupBy("query", "page").agg(body.alias("html"), F.max("failed").alias("failed"))


_WALKED = f"""w as ({_WALK}), ends as (select query, min(case when void or failed then page end) as stop from w group by query),
    rows_ as (select w.*, (id % 700)::varchar as external_id from w join ends using (query) where not void and not failed and page <= 20 and (stop is null or page < stop))"""


@query(f"with {_WALKED} select external_id, min(page) as page from rows_ group by external_id")
def searched_pages(spark, part: DataFrame) -> DataFrame:
    return walks.walked(_walk_pages(spark, part), "feed", "https://feed.example", ["query"], 20).select("external_id", "page")


@query(f"""with {_WALKED}, q as (select query, bool_or(failed) as f from w where page = 1 group by query)
    select (select count(*) from q) as queries, (select count(*) from q where f) as failed_queries, (select count(distinct (query, page)) from w where not failed and page <= 20) as pages,
    case when (select count(*) from q) > 0 and (select bool_and(f) from q) then 'error' else 'ok' end as status""")
def search_run(spark, part: DataFrame) -> DataFrame:
    return walks.searched(_walk_pages(spark, part), "feed", "https://feed.example", 20)[1]


@query(f"""with w as ({_WALK}), o as (select * from w where query = 1), stop as (select min(case when void or failed then page end) as stop from o where page <= 25)
    select distinct (id % 700)::varchar as external_id from o, stop where not void and not failed and page <= 25 and (stop is null or page < stop) and id % 700 % 3 <> 0""")
def backfilled_pages(spark, part: DataFrame) -> DataFrame:
    known = part.select((F.col("p_partkey") % 700).alias("k")).where("k % 3 = 0").select(F.col("k").cast("string").alias("external_id")).distinct()
    return walks.backfilled(_walk_pages(spark, part).where("query = 1").drop("query"), known, "feed", "https://feed.example", 25).select("external_id")


@query("""with c as (select id, source_name, observed_at from releases order by observed_at desc, id desc limit 5000),
    f as (select source_name, max((observed_at, id)) as first from c group by source_name), b as (select source_name, row_number() over (order by first desc)::int as batch from f)
    select id, source_name, batch from c join b using (source_name)""")
def reenrich_batches(releases: DataFrame) -> DataFrame:
    return walks.to_reenrich(releases.withColumn("source_kind", F.lit("feed"))).select("id", "source_name", "batch")


_URL = "case p_partkey % 6 when 0 then concat('https://anilist.co/manga/', p_partkey, '/x?y#z') when 1 then concat('https://www.mangaupdates.com/series.html?id=', p_partkey, '#f') when 2 then concat('https://mangadex.org/title/u', p_partkey) when 3 then concat('https://mangabaka.org/', p_partkey, '/report') when 4 then concat('https://example.org/manga/', p_partkey) else concat('https://MyAnimeList.net/manga/', p_partkey, '/') end"


@query(f"""select p_partkey as id, case p_partkey % 6 when 0 then 'anilist' when 1 then 'mangaupdates-legacy' when 2 then 'mangadex' when 3 then 'mangabaka' when 5 then 'mal' end as provider,
    case p_partkey % 6 when 2 then concat('u', p_partkey) when 4 then null else p_partkey::varchar end as external_id from part""")
def detected_ids(part: DataFrame) -> DataFrame:
    rows = part.select(F.col("p_partkey").alias("id"), ids.detect(F.expr(_URL)).alias("d"))
    return rows.select("id", "d.provider", F.col("d.id").alias("external_id"))


@query(f"""select p_partkey as id, case when p_partkey % 6 = 0 then concat('https://anilist.co/manga/', p_partkey, '/x?y#z') end as anilist, case when p_partkey % 6 = 5 then concat('https://MyAnimeList.net/manga/', p_partkey, '/') end as mal,
    case when p_partkey % 6 = 3 then concat('https://mangabaka.org/', p_partkey, '/report') end as mangabaka from part""")
def harvested_links(part: DataFrame) -> DataFrame:
    html = F.concat(F.lit('<a href="/x">x</a> <a href="'), F.expr(_URL), F.lit(').">y</a> https://anilist.co/anime/4 '))
    rows = part.select(F.col("p_partkey").alias("id"), ids.harvest_links(html).alias("l"))
    return rows.select("id", "l.anilist", "l.mal", "l.mangabaka")


@query("select p_partkey as id, concat('magnet:?xt=urn:btih:', md5(p_name), '&dn=', replace(p_name, ' ', '%20')) as magnet, md5(p_name) as hash from part")
def magnet_links(part: DataFrame) -> DataFrame:
    rows = part.select(F.col("p_partkey").alias("id"), ids.magnet_link(F.md5("p_name"), F.col("p_name")).alias("magnet"))
    return rows.withColumn("hash", ids.info_hash(F.col("magnet")))


@query("select o_orderkey as id, o_orderkey + 5 as stamp, o_orderkey as key, true as same from orders")
def cursor_round_trip(orders: DataFrame) -> DataFrame:
    made = ids.cursor(F.col("o_orderkey") + 5, F.col("o_orderkey"))
    rows = orders.select(F.col("o_orderkey").alias("id"), ids.cursor_parts(made).alias("p"))
    return rows.select("id", "p.stamp", F.col("p.id").alias("key"), (F.col("p.id") == F.col("id")).alias("same"))


# --- formats and values ----------------------------------------------------------

_FILES = "array('a/b.CBZ', concat('x', p_partkey, '.', case p_size % 5 when 0 then 'epub' when 1 then 'pdf' when 2 then 'foo' when 3 then 'zip' else 'nfo' end), 'cover.jpg', 'noext', '.hidden')"


@query("select p_partkey as id, case p_size % 5 when 0 then 'cbz,epub' when 1 then 'cbz,pdf' when 2 then 'cbz,foo' when 3 then 'cbz,zip' else 'cbz' end as formats from part")
def release_format_lists(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("id"), F.array_join(fm.detect_formats(F.expr(_FILES)), ",").alias("formats"))


@query("""select id, case when kind = 'novel' then true when id % 3 = 0 then true else false end as broken, (case when id % 3 = 0 then 2 else 1 end)::int as fired from series""")
def format_rules(series: DataFrame) -> DataFrame:
    found = F.when(F.col("id") % 3 == 0, F.array(F.lit("CBZ"), F.lit("epub"))).otherwise(F.array(F.lit("cbz"), F.lit("pdf")))
    return series.select("id", fm.mismatch(found, F.col("kind")).isNotNull().alias("broken"), F.size(fm.fired_rules(found)).alias("fired"))


@query("select p_partkey as id, (floor(p_retailprice * 1048576))::bigint as bytes, case when p_size > 40 then null else p_size end as count, case when p_size <= 100 then p_size / 10 end as rating from part")
def parsed_values(part: DataFrame) -> DataFrame:
    size = va.parse_size(F.concat(F.format_number("p_retailprice", 2), F.lit(" MiB")))
    count = va.parse_count(F.when(F.col("p_size") > 40, F.lit("many")).when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".7"))).otherwise(F.col("p_size").cast("string")))
    return part.select(F.col("p_partkey").alias("id"), size.alias("bytes"), count.alias("count"), va.normal_rating(F.col("p_size").cast("double")).alias("rating"))


_RANGE = "case p_partkey % 8 when 0 then '24h' when 1 then concat(p_size, 'd') when 2 then ' 15M ' when 3 then concat(p_size, 'W') when 4 then 'garbage' when 5 then concat('-', p_size, 'h') when 6 then concat(p_size, 's') end"


@query(f"""with r as (select p_partkey as id, p_size as buckets, trim({_RANGE}) as t from part),
    n as (select id, buckets, try_cast(regexp_extract(t, '^([+-]?[0-9]+)[A-Za-z]$', 1) as bigint) as n, lower(right(t, 1)) as u from r),
    s as (select id, buckets, coalesce(case when n is not null and u in ('s', 'm', 'h', 'd', 'w') then least(greatest(n * case u when 's' then 1 when 'm' then 60 when 'h' then 3600 when 'd' then 86400 else 604800 end, 60), 7776000) end, 86400)::bigint as seconds from n)
    select id, seconds, ceil(seconds / least(greatest(buckets * 5, 4), 168))::bigint as width from s""")
def range_widths(part: DataFrame) -> DataFrame:
    rows = part.select(F.col("p_partkey").alias("id"), va.range_seconds(F.expr(_RANGE)).alias("seconds"), (F.col("p_size") * 5).alias("buckets"))
    return rows.select("id", "seconds", va.bucket_width(F.col("seconds"), F.col("buckets")).alias("width"))


@query("select o_orderkey as id, cast(floor(epoch(o_orderdate)) as bigint) + 3600 as seconds from orders")
def mail_dates(orders: DataFrame) -> DataFrame:
    written = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "E, dd MMM yyyy HH:mm:ss"), F.lit(" -0100"))
    return orders.select(F.col("o_orderkey").alias("id"), F.unix_timestamp(va.parse_mail_date(written)).alias("seconds"))


@query("""select p_partkey as id, case p_size % 4 when 0 then 'one_shot' when 1 then 'manga' when 2 then 'zine' end as kind, case p_size % 3 when 0 then 'ongoing' when 1 then 'completed' else 'unknown' end as status,
    case p_size % 4 when 0 then 'network' when 1 then 'http_status' when 2 then 'parse' else 'internal' end as error from part""")
def vocabularies(part: DataFrame) -> DataFrame:
    n = F.col("p_size")
    word = F.when(n % 4 == 0, F.lit("oneshot")).when(n % 4 == 1, F.lit("manga")).when(n % 4 == 2, F.lit("zine"))
    state = F.when(n % 3 == 0, F.lit("releasing")).when(n % 3 == 1, F.lit("completed"))
    error = F.when(n % 4 == 0, F.lit("operation timed out, invalid")).when(n % 4 == 1, F.lit("bad status: 503")).when(n % 4 == 2, F.lit("cannot decode body")).otherwise(F.lit("boom"))
    return part.select(F.col("p_partkey").alias("id"), va.kind(word).alias("kind"), va.series_status(state).alias("status"), va.error_class(error).alias("error"))


@query("select doc_id as id, concat('sha256:', sha256(concat('{\"text\":\"', source, '\",\"n\":', n_chars, '}'))) as hash from documents")
def content_hashes(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), va.content_hash(F.col("source").alias("text"), F.col("n_chars").alias("n")).alias("hash"))


@query("select n_nationkey as id, concat(n_name, ';', n_regionkey, 'x') as names from nation")
def names_once(nation: DataFrame) -> DataFrame:
    given = F.array(F.concat(F.lit(" "), F.col("n_name")), F.lower("n_name"), F.lit("  "), F.concat(F.col("n_regionkey").cast("string"), F.lit("x")), F.lit(None).cast("string"))
    return nation.select(F.col("n_nationkey").alias("id"), F.array_join(va.names_once(given), ";").alias("names"))


@query("select p_partkey as id, concat(p_type, ';', p_brand) as alternates, case when p_size % 2 = 0 then p_brand else p_type end as cover, concat('fuzzy_title:', printf('%.3f', p_size / 64)) as reason from part")
def metadata_fields(part: DataFrame) -> DataFrame:
    other = F.array(F.col("p_type"), F.lit(""), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string"))
    cover = va.first_cover(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("")), F.col("p_type"))
    return part.select(F.col("p_partkey").alias("id"), F.array_join(va.alternates(F.col("p_name"), other), ";").alias("alternates"), cover.alias("cover"), va.reason(F.col("p_size") / 64).alias("reason"))
