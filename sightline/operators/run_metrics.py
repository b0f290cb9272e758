"""Run metrics: summaries, rolling statistics, baselines, regressions, health and daily reports.

Where a rule asks for a rank among a collector's values, these are counted by value first; where it asks for the latest runs, only so many are kept
before the shuffle. So no collector, however many runs it has, is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.ordered import local_stats, segments, sorted_within, windowed

BASELINE_RUNS, BASELINE_LEAST, REGRESSION_LEAST = 50, 3, 5
WINDOWS = {"hour": 3600, "day": 86_400, "week": 604_800}
FAILED = ("failed", "blocked")
#: Health also counts runs that found nothing against all expectation.
UNHEALTHY = ("failed", "blocked", "unexpected_zero")
PRODUCTION = ("production_scheduled", "production_manual")


def rate(condition: Column) -> Column:
    """The share of rows for which a condition holds."""
    return F.try_divide(F.count_if(condition).cast("double"), F.count("*"))


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def nth_value(df: DataFrame, by: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The value at index int(n * share) (from 0) among a group's values in order, nulls left out; found on counts of equal values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    group, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_at", F.floor(F.sum("_c").over(group) * share))
    return place.where("_upto > _at").groupBy(*by).agg(F.min(value).alias(name))


def summary(runs: DataFrame, since: Column) -> DataFrame:
    """One row for each collector with runs since a time: counts, rates and totals."""
    return runs.where(F.col("started_at") >= since).groupBy("collector").agg(
        F.count("*").alias("n_runs"), rounded(rate(F.col("status") == "success")).alias("success_rate"), F.sum("parser_failures").alias("parser_failures"), F.sum("http_failures").alias("http_failures"),
        F.sum("new_devices").alias("new_devices"), rounded(F.avg("duration_ms")).alias("avg_duration_ms"),
    )


def rolling(runs: DataFrame, now: Column) -> DataFrame:
    """Per collector and trailing window (hour, day, week): runs, average and 95th percentile of durations, rates, and mean time between failures."""
    spans = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(s * 1_000_000).cast("long").alias("micros")) for k, s in WINDOWS.items()])
    age = F.unix_micros(now) - F.unix_micros("started_at")
    each = runs.where(age <= max(WINDOWS.values()) * 1_000_000).withColumn("_w", F.explode(F.filter(spans, lambda x: age <= x["micros"]))).select("*", F.col("_w.window").alias("window"))
    key = ["collector", "window"]
    fails = F.count_if(F.col("status").isin(*FAILED))
    span = F.greatest((F.unix_micros(F.max("started_at")) - F.unix_micros(F.min("started_at"))) / 3.6e9, F.lit(0.01))
    stats = each.groupBy(*key).agg(
        F.count("*").alias("n_runs"), rounded(F.avg("duration_ms")).alias("avg_duration_ms"), rounded(rate(F.col("status") == "success")).alias("success_rate"), rounded(rate(F.col("status").isin(*FAILED))).alias("failure_rate"),
        rounded(F.sum(F.col("new_devices") + F.col("updated_devices")) / F.count("*")).alias("discovery_rate"), rounded(rate(F.col("parser_failures") > 0)).alias("parser_warning_rate"),
        rounded(F.when((fails > 0) & (F.count("*") > 1), span / fails)).alias("mtbf_hours"),
    )
    return stats.join(nth_value(each, key, "duration_ms", 0.95, "p95_duration_ms"), key, "left")


MEDIANS = {"duration_ms": "median_duration_ms", "candidates_found": "median_candidates", "pages_fetched": "median_pages_fetched", "http_failures": "median_http_failures"}
TRAILING = "run_id string, sample_count long, median_duration_ms double, median_candidates double, median_pages_fetched double, median_http_failures double"


def latest(runs: DataFrame, n: int) -> DataFrame:
    """The last n runs of each collector, `_n` counting back from the last. The limit applies before the shuffle, too."""
    w = Window.partitionBy("collector").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)


def baseline(runs: DataFrame) -> DataFrame:
    """Medians over each collector's last BASELINE_RUNS runs, of collectors with BASELINE_LEAST runs at least."""
    return latest(runs, BASELINE_RUNS).groupBy("collector").agg(F.count("*").alias("sample_count"), *[F.percentile(c, 0.5).alias(m) for c, m in MEDIANS.items()]).where(F.col("sample_count") >= BASELINE_LEAST)


def _trailing(rows: pd.DataFrame) -> pd.DataFrame:
    start, end = segments(rows["collector"].to_numpy())
    out = {"run_id": rows["run_id"], "sample_count": np.minimum(np.arange(len(rows)) - start + 1, BASELINE_RUNS)}
    for c, m in MEDIANS.items():
        out[m] = local_stats(rows[c].to_numpy(float), start, end, BASELINE_RUNS - 1, 0)[0]
    return pd.DataFrame(out, index=rows.index).assign(_rim=rows["_rim"] if "_rim" in rows else False)


def _part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, text = [c.split()[0] for c in TRAILING.split(", ")], {"run_id": object, "collector": object}
    columns = [*names, "edge", "_rim", "collector", "ts", *MEDIANS]
    for rows, edge in windowed(parts, "collector", BASELINE_RUNS, _trailing):
        if edge:
            yield rows.assign(edge=True).reindex(columns=columns).astype(text)
        else:
            yield rows[names].assign(edge=False, _rim=False).reindex(columns=columns).astype(text)


def _rim(rows: pd.DataFrame) -> pd.DataFrame:
    out = _trailing(sorted_within(rows, ["ts", "run_id"]))
    return out[out["_rim"].astype(bool)][[c.split()[0] for c in TRAILING.split(", ")]].astype({"run_id": object})


def rolling_baseline(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """For each run the medians over its collector's runs up to it, the last BASELINE_RUNS of them. Runs are put in order over many partitions."""
    n = partitions or int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = runs.where("started_at is not null and collector is not null").select("collector", F.unix_micros("started_at").alias("ts"), "run_id", *[F.col(c).cast("double").alias(c) for c in MEDIANS])
    schema = TRAILING + ", edge boolean, _rim boolean, collector string, ts long, " + ", ".join(f"{c} double" for c in MEDIANS)
    from sightline.plans.materialize import written

    found = written(df.repartitionByRange(n, "collector", "ts", "run_id").sortWithinPartitions("collector", "ts", "run_id").mapInPandas(_part, schema), "baselines")
    names = [c.split()[0] for c in TRAILING.split(", ")]
    rim = found.where("edge").select("collector", "ts", "run_id", "_rim", *MEDIANS).groupBy("collector").applyInPandas(_rim, TRAILING)
    return found.where("not edge").select(*names).unionByName(rim)


def regressions(runs: DataFrame, medians: DataFrame) -> DataFrame:
    """run_id, issues: what is wrong with a run against its baseline of REGRESSION_LEAST runs or more; runs without issues are left out."""
    r = runs.join(medians.where(F.col("sample_count") >= REGRESSION_LEAST), "run_id")
    c, m = F.col, lambda x: F.col(MEDIANS[x])
    issues = F.array_compact(
        F.array(
            F.when((m("duration_ms") > 0) & (c("duration_ms") > 2 * m("duration_ms")), "runtime_regression"),
            F.when((m("candidates_found") > 0) & (c("candidates_found") < 0.3 * m("candidates_found")), "candidate_collapse"),
            F.when((m("pages_fetched") > 0) & (c("pages_fetched") < 0.3 * m("pages_fetched")) & (c("status") != "blocked"), "pages_collapse"),
            F.when(c("http_failures") >= 5, "http_failure_spike"),
            F.when(c("parser_failures") >= 3, "parser_failure_spike"),
            F.when((c("pages_fetched") > 0) & (c("http_failures") == 0) & (c("candidates_found") == 0) & (m("candidates_found") > 2), "zero_candidates_despite_healthy_fetch"),
        )
    )
    return r.select("run_id", F.array_join(issues, ";").alias("issues")).where("issues <> ''")


def health(runs: DataFrame, now: Column) -> DataFrame:
    """collector, score, label: 0 to 100 over the runs of the last 7 days, with penalties for the last status, failures, warnings and lost finds."""
    week = runs.where(F.unix_micros("started_at") >= F.unix_micros(now) - 7 * 86_400_000_000)
    totals = week.groupBy("collector").agg(F.count("*").alias("n"), rate(F.col("status").isin(*UNHEALTHY)).alias("fail_rate"), F.sum("parser_failures").alias("parser"))
    last = latest(week, 10).groupBy("collector").agg(
        F.max(F.when(F.col("_n") == 1, F.col("status"))).alias("status"), F.avg("candidates_found").alias("finds"), F.sum(F.when(F.col("_n") <= 5, F.col("http_failures")).otherwise(0)).alias("http")
    )
    every = runs.select("collector").distinct().join(totals, "collector", "left").join(last, "collector", "left").join(baseline(runs).select("collector", "median_candidates"), "collector", "left")
    status = F.col("status")
    score = (
        F.lit(100)
        - F.when(status == "blocked", 79).when(status.isin("failed", "degraded"), 40).when(status == "partial", 15).when(status == "unexpected_zero", 50).otherwise(0)
        - F.when(F.col("fail_rate") > 0.5, 30).when(F.col("fail_rate") > 0.2, 15).otherwise(0)
        - F.when(F.col("parser") >= 5, 20).when(F.col("parser") >= 1, 8).otherwise(0)
        - F.when((F.col("median_candidates") > 2) & (F.col("finds") < 0.3 * F.col("median_candidates")), 26).otherwise(0)
        - F.when(F.col("http") >= 10, 25).otherwise(0)
    )
    score = F.when(F.col("n").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))
    few = F.col("n") < 3
    label = F.when(F.col("n").isNull(), "unknown").when((F.col("score") >= 75) & few, "Provisional").when(F.col("score") >= 90, "Healthy").when(F.col("score") >= 75, "Minor issues").when(F.col("score") >= 50, "Degraded").when(F.col("score") >= 25, "Unhealthy").otherwise("Blocked / critical")
    return every.withColumn("score", score.cast("int")).select("collector", "score", label.alias("label"))


def local_day(at: Column, tz: str) -> Column:
    """The calendar day of a UTC time in a time zone."""
    return F.to_date(F.from_utc_timestamp(at, tz))


def daily(runs: DataFrame, tz: str = "Asia/Kolkata") -> DataFrame:
    """One row for each local day: production runs in figures, other runs apart; slowest (a null duration counts as 0) and fastest collector; ties by name."""
    prod = F.col("run_reason").isin(*PRODUCTION)
    key = lambda sign: F.struct((sign * F.coalesce("duration_ms", F.lit(0))).alias("a"), F.col("collector").alias("b"))
    return runs.withColumn("day", local_day(F.col("started_at"), tz)).groupBy("day").agg(
        F.count_if(prod).alias("n_runs"), F.count_if(~prod).alias("other_runs"), rounded(F.try_divide(F.count_if(prod & (F.col("status") == "success")).cast("double"), F.count_if(prod))).alias("success_rate"),
        F.countDistinct(F.when(prod, F.col("collector"))).alias("collectors_run"), F.coalesce(F.sum(F.when(prod, F.col("new_devices"))), F.lit(0)).alias("new_discoveries"), F.coalesce(F.sum(F.when(prod, F.col("updated_devices"))), F.lit(0)).alias("updated_devices"),
        F.min(F.when(prod, key(F.lit(-1)))).getField("b").alias("slowest"), F.min(F.when(prod & F.col("duration_ms").isNotNull(), key(F.lit(1)))).getField("b").alias("fastest"),
    )
