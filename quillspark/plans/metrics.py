"""Operational queries: run summaries, buckets, percentiles, tallies, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.values import QUEUE_STATUSES
from quillspark.operators import aggregates as ag
from quillspark.operators import filters, merges, paging
from quillspark.plans.registry import query

SINCE, UNTIL, WIDTH = 1704067200, 1706400000, 86400


def _summary_sql(key: str, counters: list[str]) -> str:
    sums = ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}_sum" for c in counters)
    return f"""
    select {key}, count(*) as runs, count(*) filter (status = 'success') as successes, count(*) filter (status = 'failure') as failures,
           count(*) filter (status = 'skipped') as skips, {sums}, max(started_at) as last_started_at, max(case when rn = 1 then status end) as last_status,
           case when count(*) filter (status in ('success', 'failure')) > 0
                then round(count(*) filter (status = 'success') / count(*) filter (status in ('success', 'failure')), 6) end as success_rate
    from (select *, row_number() over (partition by {key} order by started_at desc, id desc) as rn
          from (select *, id % 11 as provider from runs) where started_at >= {SINCE} and started_at < {UNTIL}) group by {key}"""


@query(_summary_sql("source", ["fetched", "added"]))
def source_summary(runs: DataFrame) -> DataFrame:
    out = ag.run_summary(runs, "source", ["fetched", "added"], SINCE, UNTIL)
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query(_summary_sql("provider", ["fetched"]))
def provider_summary(runs: DataFrame) -> DataFrame:
    out = ag.run_summary(runs.withColumn("provider", F.col("id") % 11), "provider", ["fetched"], SINCE, UNTIL)
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query(f"""select source, ((started_at - {SINCE}) // {WIDTH}) * {WIDTH} + {SINCE} as bucket_start, count(*) as runs,
    count(*) filter (status = 'failure') as failures, coalesce(sum(fetched), 0)::bigint as fetched_sum
    from runs where started_at >= {SINCE} and started_at < {UNTIL} group by all""")
def source_buckets(runs: DataFrame) -> DataFrame:
    return ag.time_buckets(runs, ["source"], SINCE, UNTIL, WIDTH, F.count("*").alias("runs"), F.count_if(F.col("status") == "failure").alias("failures"), F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched_sum"))


@query(f"""select ((started_at - {SINCE}) // 7200) * 7200 + {SINCE} as bucket_start, count(*) as runs, max(finished_at) as last_finished
    from runs where started_at >= {SINCE} and started_at < {UNTIL} group by all""")
def provider_buckets(runs: DataFrame) -> DataFrame:
    return ag.time_buckets(runs, [], SINCE, UNTIL, 7200, F.count("*").alias("runs"), F.max("finished_at").alias("last_finished"))


@query("select error_kind, count(*) as n from runs where status = 'failure' group by error_kind")
def error_kinds(runs: DataFrame) -> DataFrame:
    return ag.histogram(runs.where("status = 'failure'"), "error_kind")


_RANKS = """select {keys} max(n) as n, max(case when rn = greatest(floor(0.5::double * n + 0.5), 1) then v end) as p50,
    max(case when rn = greatest(floor(0.95::double * n + 0.5), 1) then v end) as p95, max(v) as max
    from (select *, row_number() over ({by} order by v) as rn, count(*) over ({by}) as n from ({rows})) {group}"""


@query(_RANKS.format(keys="source,", by="partition by source", rows="select source, finished_at - started_at as v from runs where finished_at is not null", group="group by source"))
def fetch_latency_by_source(runs: DataFrame) -> DataFrame:
    rows = runs.withColumn("v", F.col("finished_at") - F.col("started_at"))
    return ag.nearest_rank(rows, "v", {"p50": 0.5, "p95": 0.95}, ["source"])


@query(_RANKS.format(keys="", by="", rows="select finished_at - started_at as v from runs where finished_at is not null", group=""))
def fetch_latency(runs: DataFrame) -> DataFrame:
    return ag.nearest_rank(runs.withColumn("v", F.col("finished_at") - F.col("started_at")), "v", {"p50": 0.5, "p95": 0.95})


@query(_RANKS.format(keys="o_orderpriority,", by="partition by o_orderpriority", rows="select o_orderpriority, cast(floor(epoch(l_shipdate)) as bigint) - cast(floor(epoch(o_orderdate)) as bigint) as v from lineitem join orders on l_orderkey = o_orderkey", group="group by o_orderpriority"))
def time_to_resolution(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select("l_orderkey", "l_shipdate").join(orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return ag.nearest_rank(rows.withColumn("v", seconds("l_shipdate") - seconds("o_orderdate")), "v", {"p50": 0.5, "p95": 0.95}, ["o_orderpriority"])


@query(_RANKS.format(keys="", by="", rows="select resolved_at - observed_at as v from releases where resolved_at is not null", group=""))
def time_to_decision(releases: DataFrame) -> DataFrame:
    return ag.nearest_rank(releases.withColumn("v", F.col("resolved_at") - F.col("observed_at")), "v", {"p50": 0.5, "p95": 0.95})


@query("""select count(*) as total, count(*) filter (resolution_status = 'resolved') as resolved, count(*) filter (resolution_status = 'unresolved') as unresolved,
    count(*) filter (resolution_status = 'ambiguous') as ambiguous, count(*) filter (resolution_status = 'review_pending') as review_pending, count(*) filter (resolution_status = 'rejected') as rejected from releases""")
def status_counts(releases: DataFrame) -> DataFrame:
    return ag.counts_by_status(releases, ["resolved", "unresolved", "ambiguous", "review_pending", "rejected"], "resolution_status")


@query("""select count(*) filter (resolution_status = 'unresolved') as unresolved, count(*) filter (resolution_status = 'ambiguous') as ambiguous,
    count(*) filter (resolution_status = 'review_pending') as review_pending,
    1900000000 - min(observed_at) filter (resolution_status in ('unresolved', 'ambiguous', 'review_pending')) as oldest_pending_seconds, 1900000000 as captured_at from releases""")
def queue_snapshot(releases: DataFrame) -> DataFrame:
    waiting = F.col("resolution_status").isin(QUEUE_STATUSES)
    counts = [F.count_if(F.col("resolution_status") == s).alias(s) for s in QUEUE_STATUSES]
    oldest = (F.lit(1900000000) - F.min(F.when(waiting, F.col("observed_at")))).alias("oldest_pending_seconds")
    return releases.agg(*counts, oldest).withColumn("captured_at", F.lit(1900000000))


@query("select id, started_at, fetched from runs where started_at >= 1704153600 and started_at < 1704240000")
def snapshots_between(runs: DataFrame) -> DataFrame:
    return runs.where(filters.between_times("started_at", 1704153600, 1704240000)).select("id", "started_at", "fetched")


@query("""select count(*) filter (resolution_status = 'resolved' and resolution_path = 'known_external_id') as known_id,
    count(*) filter (resolution_status = 'resolved' and resolution_path = 'foreign_id_lookup') as foreign_id,
    count(*) filter (resolution_status = 'resolved' and resolution_path = 'fuzzy_title') as fuzzy,
    count(*) filter (resolution_status in ('review_pending', 'ambiguous')) as review,
    count(*) filter (resolution_status not in ('resolved', 'review_pending', 'ambiguous')) as failed from releases""")
def outcome_tally(releases: DataFrame) -> DataFrame:
    return ag.outcome_tally(releases)


@query("""with t as (select resolution_status as status, series_id is null and id % 5 = 0 as skipped, id % 11 = 0 as failed from releases)
    select count(*) filter (not failed and not skipped and status = 'resolved') as resolved, count(*) filter (not failed and not skipped and status = 'ambiguous') as ambiguous,
    count(*) filter (not failed and not skipped and status = 'review_pending') as review_pending, count(*) filter (not failed and not skipped and status = 'unresolved') as unresolved,
    count(*) filter (not failed and (skipped or status in ('rejected', 'standalone'))) as skipped, count(*) filter (failed) as errors from t""")
def retry_tally(releases: DataFrame) -> DataFrame:
    return ag.retry_tally(releases.select("resolution_status", (F.col("series_id").isNull() & (F.col("id") % 5 == 0)).alias("skipped"), (F.col("id") % 11 == 0).alias("failed")))


@query("select provider, count(*) as ids, count(distinct series_id) as series, count(*) filter (external_id like '%0') as tombstones, max(series_id) as newest from external_ids group by provider")
def id_map_counts(external_ids: DataFrame) -> DataFrame:
    return external_ids.groupBy("provider").agg(F.count("*").alias("ids"), F.count_distinct("series_id").alias("series"), F.count_if(F.col("external_id").like("%0")).alias("tombstones"), F.max("series_id").alias("newest"))


@query("select source, max(id) as id, count(*) > 0 as in_flight from runs where status = 'running' group by source")
def in_flight(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'running'").groupBy("source").agg(F.max("id").alias("id"), (F.count("*") > 0).alias("in_flight"))


@query("select id, source, started_at, status from runs order by started_at desc, id desc limit 50")
def recent_runs(runs: DataFrame) -> DataFrame:
    return paging.newest(runs, "started_at", 50).select("id", "source", "started_at", "status")


@query("""select r.id, r.started_at, coalesce(c.status, 'running') as status, c.finished_at, c.fetched from runs r
    left join (select id, status, finished_at, fetched from runs where finished_at is not null and id % 4 <> 0) c on r.id = c.id""")
def run_history(runs: DataFrame) -> DataFrame:
    closed = runs.where("finished_at is not null and id % 4 <> 0").select("id", "status", "finished_at", "fetched")
    return merges.run_history(runs.select("id", "started_at"), closed).select("id", "started_at", "status", "finished_at", "fetched")


@query("""select r.id, coalesce(u.fetched, r.fetched) as fetched, coalesce(u.added, r.added) as added from runs r
    left join (select id, case when id % 2 = 0 then id end as fetched, case when id % 3 = 0 then id * 2 end as added from runs where id % 5 = 0) u on r.id = u.id""")
def run_progress(runs: DataFrame) -> DataFrame:
    update = runs.where("id % 5 = 0").select("id", F.expr("case when id % 2 = 0 then id end").alias("fetched"), F.expr("case when id % 3 = 0 then id * 2 end").alias("added"))
    return merges.progress(runs.select("id", "fetched", "added"), update, "id", ["fetched", "added"])


@query("""select id, case when status = 'running' then 1800000000 else finished_at end as finished_at, case when status = 'running' then 'interrupted' else error_kind end as error,
    case when status = 'running' then 'error' else status end as outcome from runs""")
def interrupted_runs(runs: DataFrame) -> DataFrame:
    rows = runs.select("id", "finished_at", F.col("error_kind").alias("error"), F.col("status").alias("outcome"))
    return merges.interrupt_running(rows, 1800000000)
