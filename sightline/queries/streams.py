"""Queries through Structured Streaming: the stream runs over the whole table, its result equals the batch's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.queries.registry import Registry
from sightline.session import workspace
from sightline.streaming import jobs

STREAMS = Registry()


def _source(spark: SparkSession, sf_dir: str, table: str, time: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    return jobs.read(spark, path if folder else f"{sf_dir}/{table}.parque*", schema, time)


def _table(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The stream's final result, from a table in the shared folder that the last micro-batch overwrote."""
    place = f"{workspace(spark)}/streams/{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out")).outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@STREAMS.add(
    """select strftime(started_at, '%Y-%m-%d') as day, lower(trim(collector_name)) collector, count(*) n_runs, count(*) filter (status = 'success') n_success, count(*) filter (status in ('failed', 'blocked')) n_failed, cast(sum(candidates_found) as bigint) candidates
from (select *, row_number() over (partition by id order by landed_at nulls last) n from collector_run_metrics where id is not null) where n = 1 group by 1, 2"""
)
def q51_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by day from a stream, each run once."""
    out = _table(spark, jobs.runs_by_day(_source(spark, sf_dir, "collector_run_metrics", "started_at").where("id is not null"), late="400 days"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@STREAMS.add("with w as (select user_id, ts, sum(case when b is null or date_diff('microsecond', b, ts) >= 3600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) s from (select *, lag(ts) over (partition by user_id order by ts, event_id) b from events)) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as \"start\", count(*) events from w group by user_id, s")
def q52_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users from a stream."""
    out = _table(spark, jobs.sessions(_source(spark, sf_dir, "events", "ts"), late="400 days"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")
