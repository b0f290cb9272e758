"""Queries on run metrics and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators import run_metrics as M
from sightline.queries.registry import Registry
from sightline.sources import views as V
from sightline.sources.tables import table

METRICS = Registry()
NOW_SQL = "now_ as (select max(started_at) t from runs)"
RATE = lambda c: f"round(count(*) filter ({c}) / count(*)::double, 6)"


def latest_start(runs: DataFrame) -> Column:
    """The clock of these queries: the last start in the table, one value, found when the query runs."""
    return runs.agg(F.max("started_at")).scalar()


@METRICS.add(
    f"with {V.RUNS_SQL}, {NOW_SQL} select collector, count(*) n_runs, {RATE("status = 'success'")} success_rate, cast(sum(parser_failures) as bigint) parser_failures, cast(sum(http_failures) as bigint) http_failures, cast(sum(new_devices) as bigint) new_devices, round(avg(duration_ms), 6) avg_duration_ms from runs, now_ where started_at >= t - interval 1 day group by 1"
)
def q21_summary_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collector's last day."""
    r = V.runs(spark, sf_dir)
    return M.summary(r, latest_start(r) - F.expr("interval 1 day"))


@METRICS.add(
    f"""with {V.RUNS_SQL}, {NOW_SQL}, w as (select 'hour' win, interval 1 hour i union all select 'day', interval 1 day union all select 'week', interval 7 day),
e as (select runs.*, win from runs, now_, w where started_at >= t - i)
select collector, win as "window", count(*) n_runs, round(avg(duration_ms), 6) avg_duration_ms, {RATE("status = 'success'")} success_rate, {RATE("status in ('failed', 'blocked')")} failure_rate,
  round(sum(new_devices + updated_devices) / count(*)::double, 6) discovery_rate, {RATE("parser_failures > 0")} parser_warning_rate,
  round(case when count(*) filter (status in ('failed', 'blocked')) > 0 and count(*) > 1 then greatest(date_diff('microsecond', min(started_at), max(started_at)) / 3.6e9, 0.01) / count(*) filter (status in ('failed', 'blocked')) end, 6) mtbf_hours,
  list_sort(list(duration_ms) filter (duration_ms is not null))[cast(floor(count(duration_ms) * 0.95) as integer) + 1] p95_duration_ms
from e group by 1, 2"""
)
def q22_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the last hour, day and week."""
    r = V.runs(spark, sf_dir)
    return M.rolling(r.withColumn("_now", latest_start(r)), F.col("_now"))


BASE = "rows between 49 preceding and current row"


@METRICS.add(
    f"""with {V.RUNS_SQL} select run_id, count(*) over w sample_count, median(duration_ms) over w median_duration_ms, median(candidates_found) over w median_candidates, median(pages_fetched) over w median_pages_fetched, median(http_failures) over w median_http_failures
from runs where started_at is not null window w as (partition by collector order by started_at, run_id {BASE})"""
)
def q23_rolling_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over the last 50 runs up to each run."""
    return M.rolling_baseline(V.runs(spark, sf_dir))


@METRICS.add(
    f"""with {V.RUNS_SQL}, m as (select *, count(*) over w n, median(duration_ms) over w md, median(candidates_found) over w mc, median(pages_fetched) over w mp from runs window w as (partition by collector order by started_at, run_id {BASE})),
i as (select run_id, array_to_string(list_filter([
  case when md > 0 and duration_ms > 2 * md then 'runtime_regression' end, case when mc > 0 and candidates_found < 0.3::double * mc then 'candidate_collapse' end,
  case when mp > 0 and pages_fetched < 0.3::double * mp and status <> 'blocked' then 'pages_collapse' end, case when http_failures >= 5 then 'http_failure_spike' end, case when parser_failures >= 3 then 'parser_failure_spike' end,
  case when pages_fetched > 0 and http_failures = 0 and candidates_found = 0 and mc > 2 then 'zero_candidates_despite_healthy_fetch' end], lambda x: x is not null), ';') issues from m where n >= 5)
select * from i where issues <> ''"""
)
def q24_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a run against the runs before it."""
    r = V.runs(spark, sf_dir)
    return M.regressions(r, M.rolling_baseline(r))


@METRICS.add(
    f"""with {V.RUNS_SQL}, {NOW_SQL}, wk as (select runs.*, row_number() over (partition by collector order by started_at desc, run_id desc) n from runs, now_ where started_at >= t - interval 7 day),
t1 as (select collector, count(*) c, count(*) filter (status in ('failed', 'blocked', 'unexpected_zero')) / count(*)::double fr, sum(parser_failures) pf, max(case when n = 1 then status end) st, avg(candidates_found) filter (n <= 10) fi, sum(http_failures) filter (n <= 5) ht from wk group by 1),
b as (select collector, median(candidates_found) mc, count(*) k from (select *, row_number() over (partition by collector order by started_at desc, run_id desc) n from runs) where n <= 50 group by 1 having count(*) >= 3),
s as (select c.collector, t1.c, case when t1.c is null then 0 else greatest(0, least(100, 100 - case st when 'blocked' then 79 when 'failed' then 40 when 'degraded' then 40 when 'partial' then 15 when 'unexpected_zero' then 50 else 0 end
  - case when fr > 0.5 then 30 when fr > 0.2 then 15 else 0 end - case when pf >= 5 then 20 when pf >= 1 then 8 else 0 end - case when mc > 2 and fi < 0.3::double * mc then 26 else 0 end - case when ht >= 10 then 25 else 0 end)) end score
  from (select distinct collector from runs) c left join t1 using (collector) left join b using (collector))
select collector, cast(score as integer) score, case when c is null then 'unknown' when score >= 75 and c < 3 then 'Provisional' when score >= 90 then 'Healthy' when score >= 75 then 'Minor issues' when score >= 50 then 'Degraded' when score >= 25 then 'Unhealthy' else 'Blocked / critical' end as "label" from s"""
)
def q25_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collector's health score and label."""
    r = V.runs(spark, sf_dir)
    return M.health(r, latest_start(r))


@METRICS.add(
    f"""with {V.RUNS_SQL}, d as (select *, strftime(started_at + interval '5 hours 30 minutes', '%Y-%m-%d') as day, run_reason in ('production_scheduled', 'production_manual') p from runs)
select day, count(*) filter (p) n_runs, count(*) filter (not p) other_runs, round(count(*) filter (p and status = 'success') / nullif(count(*) filter (p), 0)::double, 6) success_rate, count(distinct collector) filter (p) collectors_run,
  cast(coalesce(sum(new_devices) filter (p), 0) as bigint) new_discoveries, cast(coalesce(sum(updated_devices) filter (p), 0) as bigint) updated_devices,
  arg_min(collector, (-coalesce(duration_ms, 0), collector)) filter (p) slowest, arg_min(collector, (duration_ms, collector)) filter (p and duration_ms is not null) fastest
from d group by day"""
)
def q26_daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each local day."""
    return M.daily(V.runs(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@METRICS.add(
    f"""with {V.RUNS_SQL}, d as (select distinct strftime(started_at, '%Y-%m-%d') as day, collector from runs), c as (select distinct collector from runs), x as (select distinct day from d)
select x.day, string_agg(c.collector, ',' order by c.collector) missing from x join c on not exists (select 1 from d where d.day = x.day and d.collector = c.collector) group by 1"""
)
def q27_missing_collectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collectors that are expected and didn't run, for each day: all names less the day's names, as sets; there are as many names as collectors."""
    d = V.runs(spark, sf_dir).select(F.date_format("started_at", "yyyy-MM-dd").alias("day"), "collector").distinct()
    expected = d.agg(F.array_sort(F.collect_set("collector")))  # one row of names, put in as a value; array_except keeps their order
    ran = d.groupBy("day").agg(F.collect_set("collector").alias("_ran"))
    return ran.select("day", F.array_join(F.array_except(expected.scalar(), F.col("_ran")), ",").alias("missing")).where("missing <> ''")


@METRICS.add(f"with {V.RUNS_SQL}, {NOW_SQL} select collector, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') last_run, arg_max(status, (started_at, run_id)) last_status, max(started_at) + interval 3 hour <= any_value(t) due from runs, now_ group by 1")
def q28_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collector's last run, and whether the next, 3 hours after it, is due."""
    r = V.runs(spark, sf_dir)
    last = r.groupBy("collector").agg(F.max(F.struct("started_at", "run_id", "status")).alias("l"))
    return last.select("collector", F.date_format("l.started_at", "yyyy-MM-dd HH:mm:ss").alias("last_run"), F.col("l.status").alias("last_status"), (F.col("l.started_at") + F.expr("interval 3 hours") <= latest_start(r)).alias("due"))


@METRICS.add(
    f"with {V.RUNS_SQL}, f as (select collector, min(started_at) filter (status = 'success') first_success, count(*) run_count from runs group by 1) select collector, strftime(first_success, '%Y-%m-%d %H:%M:%S') first_success, run_count, (select count(*) from runs r where r.collector = f.collector and r.started_at > f.first_success) later_runs from f"
)
def q29_baseline_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a collector first succeeded, and its runs since."""
    r = V.runs(spark, sf_dir)
    f = r.groupBy("collector").agg(F.min(F.when(F.col("status") == "success", F.col("started_at"))).alias("first_success"), F.count("*").alias("run_count"))
    later = r.select("collector", "started_at").join(f, "collector").groupBy("collector").agg(F.count_if(F.col("started_at") > F.col("first_success")).alias("later_runs"))
    return f.join(later, "collector").select("collector", F.date_format("first_success", "yyyy-MM-dd HH:mm:ss").alias("first_success"), "run_count", "later_runs")


@METRICS.add(f"with {V.RUNS_SQL} select collector, count(*) silent_runs from runs where valid_devices > 0 and new_devices + updated_devices = 0 and status = 'success' group by 1")
def q30_silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that found valid devices of which none became new or updated."""
    return V.runs(spark, sf_dir).where("valid_devices > 0 and new_devices + updated_devices = 0 and status = 'success'").groupBy("collector").agg(F.count("*").alias("silent_runs"))


@METRICS.add(f"with {V.RUNS_SQL} select collector, status, run_reason, count(*) n, grouping_id(collector, status, run_reason) level from runs group by cube (collector, status, run_reason)")
def q31_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by collector, status and reason, with all subtotals."""
    return V.runs(spark, sf_dir).cube("collector", "status", "run_reason").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@METRICS.add("select channel, count(*) deliveries, count(*) filter (eligible) eligible, count(*) filter (suppressed) suppressed, count(*) filter (attempted) attempted, count(*) filter (delivered) delivered, count(*) filter (attempted and not delivered) failed from webhook_deliveries where not test_mode group by 1")
def q32_channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries per channel by what became of them."""
    w = table(spark, sf_dir, "webhook_deliveries", "channel", "test_mode", "eligible", "suppressed", "attempted", "delivered").where("not test_mode")
    counts = [F.count_if(F.col(c)).alias(c) for c in ("eligible", "suppressed", "attempted", "delivered")]
    return w.groupBy("channel").agg(F.count("*").alias("deliveries"), *counts, F.count_if(F.col("attempted") & ~F.col("delivered")).alias("failed"))


@METRICS.add("select channel, landing_no, status_code, left(error_message, 60) error_message from (select *, row_number() over (partition by channel order by created_at desc nulls last, landing_no desc) n from webhook_deliveries where attempted and not delivered) where n <= 10")
def q33_last_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten failed deliveries of each channel."""
    w = table(spark, sf_dir, "webhook_deliveries", "channel", "landing_no", "status_code", "error_message", "created_at", "attempted", "delivered").where("attempted and not delivered")
    by = Window.partitionBy("channel").orderBy(F.desc_nulls_last("created_at"), F.desc("landing_no"))
    return w.withColumn("_n", F.row_number().over(by)).where("_n <= 10").select("channel", "landing_no", "status_code", F.substring("error_message", 1, 60).alias("error_message"))


@METRICS.add("select channel, status_code, count(*) n, row_number() over (partition by channel order by count(*) desc, status_code nulls first) place from webhook_deliveries where attempted group by 1, 2")
def q34_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each status came back, most frequent first."""
    h = table(spark, sf_dir, "webhook_deliveries", "channel", "status_code", "attempted").where("attempted").groupBy("channel", "status_code").agg(F.count("*").alias("n"))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("n"), F.asc_nulls_first("status_code"))).cast("long"))
