from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sightline.operators import page_changes as P
from sightline.operators.message_store import MessageStore
from sightline.streaming import jobs

T0 = datetime(2020, 1, 1)


def test_page_monitor_equals_batch(spark, tmp_path):
    codes = [200, 404, 404, 500, 410, 404, 200, 404, 200, 404, 404, 404]
    df = spark.createDataFrame([(str(i), "s", f"u{u}", T0 + timedelta(days=i), c) for u in range(3) for i, c in enumerate(codes[u:])], "id string, source string, url string, fetched_at timestamp, status_code int")
    for i in range(0, 12, 4):  # in several files, so that state is carried
        df.where(F.dayofmonth("fetched_at").between(i + 1, i + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.page_monitor(jobs.read(spark, str(tmp_path / "in"), df.schema, "fetched_at", files=1))
    got = {(r["url"], r["fetched_at"], r["page_state"]) for r in jobs.finished(stream, "monitor", str(tmp_path / "cp"), "append").collect()}
    want = {(r["url"], r["fetched_at"], r["page_state"]) for r in P.removals(df).where("page_state is not null").collect()}
    assert got == want and got


def test_messages_once_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 5}", "r", T0 + timedelta(minutes=i)) for i in range(40)], "landing_no long, dedupe_key string, reason string, attempted_at timestamp")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    store = MessageStore(spark, ["dedupe_key", "reason"], "attempted_at", "landing_no", 2)
    for run in ("a", "b"):  # all batches once more, by another stream
        jobs.messages_once(jobs.read(spark, str(tmp_path / "in"), df.schema, "attempted_at", files=1), store, str(tmp_path / run), compact_every=2).awaitTermination()
    assert sorted(r["_order"] for r in store.kept().collect()) == [0, 1, 2, 3, 4]


def test_late_rows_and_sliding(spark, tmp_path):
    rows = [(f"i{n}", "C ", T0 + timedelta(hours=6 * n), "success", 1) for n in range(12)]
    df = spark.createDataFrame(rows + rows[:3], "id string, collector_name string, started_at timestamp, status string, candidates_found int")
    df.write.parquet(str(tmp_path / "in"))
    day = jobs.finished(jobs.runs_by_day(jobs.read(spark, str(tmp_path / "in"), df.schema, "started_at")), "days", str(tmp_path / "a"))
    assert sorted(r["n_runs"] for r in day.collect()) == [4, 4, 4]
    slide = jobs.finished(jobs.runs_sliding(jobs.read(spark, str(tmp_path / "in"), df.schema, "started_at"), "2 days", "1 day"), "slide", str(tmp_path / "b"))
    assert slide.agg(F.sum("n_runs")).first()[0] == 2 * 15
    q = jobs.to_table(jobs.runs_by_day(jobs.read(spark, str(tmp_path / "in"), df.schema, "started_at"), "1 day"), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1
