"""The relations that the queries run on, derived from the driver's tables; SQL has the same as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import folded
from sightline.sources.tables import table

RUN_COLUMNS = ("duration_ms", "status", "pages_requested", "pages_fetched", "http_requests", "http_failures", "parser_failures", "candidates_found", "valid_devices", "new_devices", "updated_devices", "run_reason")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collector_run_metrics, each run once (its first landing): run_id, collector, started_at, and the counters."""
    df = table(spark, sf_dir, "collector_run_metrics", "id", "collector_name", "started_at", "landed_at", *RUN_COLUMNS).where("id is not null")
    first = F.min(F.struct(F.col("landed_at").isNull().alias("_none"), "landed_at", "collector_name", "started_at", *RUN_COLUMNS)).alias("r")
    return df.groupBy(F.col("id").alias("run_id")).agg(first).select("run_id", folded(F.col("r.collector_name")).alias("collector"), F.col("r.started_at").cast("timestamp").alias("started_at"), *[f"r.{c}" for c in RUN_COLUMNS])


RUNS_SQL = f"""runs as (
  select id run_id, lower(trim(collector_name)) collector, started_at, {", ".join(RUN_COLUMNS)}
  from (select *, row_number() over (partition by id order by landed_at nulls last) rn from collector_run_metrics where id is not null) where rn = 1)"""


def snapshots(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """snapshots, each id once: its first fetch."""
    df = table(spark, sf_dir, "snapshots", "id", *dict.fromkeys(("fetched_at", *columns))).where("id is not null")
    first = F.min(F.struct(F.col("fetched_at").isNull().alias("_none"), "fetched_at", *[c for c in columns if c != "fetched_at"])).alias("r")
    return df.groupBy("id").agg(first).select("id", *[f"r.{c}" for c in columns])


SNAPSHOTS_SQL = "snaps as (select * from (select *, row_number() over (partition by id order by fetched_at nulls last) rn from snapshots where id is not null) where rn = 1)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sightings of devices: orders as evidence, with the weight of their kind of source."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")
    kind = F.when(F.col("o_orderstatus") == "F", "official").when(F.col("o_orderstatus") == "O", "certification").otherwise("support_page")
    weight = F.when(F.col("o_orderpriority").startswith("1"), 35).when(F.col("o_orderpriority").startswith("2"), 25).when(F.col("o_orderpriority").startswith("3"), 20).otherwise(10)
    return o.select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("device_id"), kind.alias("source_type"), F.col("o_orderpriority").alias("source"), weight.cast("long").alias("weight"), F.col("o_orderdate").alias("first_seen"), F.floor("o_totalprice").cast("long").alias("content"))


EVIDENCE_SQL = """evidence as (
  select o_orderkey evidence_id, o_custkey device_id, case o_orderstatus when 'F' then 'official' when 'O' then 'certification' else 'support_page' end source_type, o_orderpriority source,
    cast(case when starts_with(o_orderpriority, '1') then 35 when starts_with(o_orderpriority, '2') then 25 when starts_with(o_orderpriority, '3') then 20 else 10 end as bigint) weight,
    o_orderdate first_seen, cast(floor(o_totalprice) as bigint) content
  from orders)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ledger entries: line items as points for the device of their order, under the rule of their flag; the same evidence and rule may come twice."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("device_id"), F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("rule"), F.col("l_quantity").cast("int").cast("long").alias("points")
    )


LEDGER_SQL = "ledger as (select o_custkey device_id, l_orderkey evidence_id, l_linenumber line, l_returnflag rule, cast(cast(l_quantity as integer) as bigint) points from lineitem join orders on l_orderkey = o_orderkey)"
