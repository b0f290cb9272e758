"""The same results from streams: each job reads what is there (availableNow) or goes on, and may be replayed without effect."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.functions.text import folded
from sightline.operators.message_store import MessageStore
from sightline.operators.run_metrics import FAILED


def read(spark: SparkSession, path: str, schema, time: str, files: int = 100) -> DataFrame:
    """A Parquet folder as a stream, its time column as a timestamp (event time can't be without a zone)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def runs_by_day(runs: DataFrame, late: str = "7 days") -> DataFrame:
    """Runs, successes and finds per collector and day; each run once, if its copies land within the time allowed for late rows."""
    once = runs.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["id"])
    key = [F.window("started_at", "1 day").alias("w"), folded(F.col("collector_name")).alias("collector")]
    return once.groupBy(*key).agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status").isin(*FAILED)).alias("n_failed"), F.sum("candidates_found").alias("candidates")).select(
        F.col("w.start").alias("day"), "collector", "n_runs", "n_success", "n_failed", "candidates"
    )


def runs_sliding(runs: DataFrame, size: str = "7 days", step: str = "1 day", late: str = "7 days") -> DataFrame:
    """Runs per collector in windows that overlap."""
    return runs.withWatermark("started_at", late).groupBy(F.window("started_at", size, step).alias("w"), folded(F.col("collector_name")).alias("collector")).agg(F.count("*").alias("n_runs")).select(F.col("w.start").alias("start"), "collector", "n_runs")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per user and session: a session ends when nothing comes for the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


STREAK_STATE = "misses int, removed boolean"
STREAKS = "source string, url string, fetched_at timestamp, page_state string"


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, misses: int) -> Iterator[pd.DataFrame]:
    """A page's misses in a row, kept from batch to batch: removed at the limit, restored at the next success; other failures say nothing."""
    run, gone = state.get if state.exists else (0, False)
    out = []
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["fetched_at", "id"])
    for at, code in zip(rows["fetched_at"], rows["status_code"], strict=True):
        if code in (404, 410):
            run += 1
            if run == misses and not gone:
                gone = True
                out.append((*key, at, "PAGE_REMOVED"))
        elif 200 <= code <= 299:
            if gone:
                out.append((*key, at, "PAGE_RESTORED"))
            run, gone = 0, False
    state.update((int(run), bool(gone)))
    yield pd.DataFrame(out, columns=["source", "url", "fetched_at", "page_state"])


def page_monitor(fetches: DataFrame, misses: int = 3) -> DataFrame:
    """Pages removed and restored, as fetches come in; of each page its misses in a row are kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        yield from _streak(key, batches, state, misses)

    known = fetches.where("status_code is not null").select("source", "url", "id", "fetched_at", "status_code")
    return known.groupBy("source", "url").applyInPandasWithState(run, STREAKS, STREAK_STATE, "append", GroupStateTimeout.NoTimeout)


def messages_once(deliveries: DataFrame, store: MessageStore, checkpoint: str, compact_every: int = 50):
    """Upserts each micro-batch of deliveries into the store and compacts its runs now and then. A batch that is replayed changes nothing."""

    def put(batch: DataFrame, n: int) -> None:
        store.upsert(batch)
        if n and n % compact_every == 0:
            store.compact()

    return deliveries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and gives its result table (kept in memory: for small results and tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's finished windows to a Parquet table, each exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
