from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators.message_store import MessageStore, deduplicated
from sightline.operators.metric_spikes import HALO, RISK, STUCK, THRESHOLD, metric_spikes, tails
from sightline.operators.ordered import local_stats, same_run, segments, windowed
from sightline.operators.snapshot_changes import snapshot_changes
from sightline.plans.materialize import written
from sightline.queries.problems import p3_found

T0 = datetime(2020, 1, 1)
SNAP = "id string, source string, url string, sweep_no int, fetched_at timestamp, content_hash string, text_hash string, dom_hash string, change_summary string, status_code int, _n int, _s string, kind string"


def snap(i, source, url, sweep, h="aa", at=0, text=None, summary=None):
    return (str(i), source, url, sweep, T0 + timedelta(hours=at) if at is not None else None, h, text, None, summary, 200, 1, "x", "y")


def test_snapshot_changes(spark):
    rows = [
        snap(1, "s", "HTTPS://H.example/A/?utm_source=x#y", 1), snap(2, "s", "https://h.example/A", 3, "AA"),  # the same, in other spellings
        snap(3, "s", "https://h.example/b", 1, "bb"), snap(4, "s", "https://h.example/b/", 3, "cc", 1), snap(5, "s", "https://h.example/b", 3, "bb", 5), snap(5, "s", "https://h.example/b", 3, "bb", 5),  # the latest fetch counts
        snap(6, "s", "https://h.example/gone", 1), snap(7, "s", "https://h.example/gone", 4),  # away, and back
        snap(8, "s", "https://h.example/new", 3, None), snap(9, "s", "https://h.example/new", 4, "zz"),  # a null is no difference
        snap(10, "s", "https://h.example/j", 3, summary='{"a": 1, "b": [1, 2]}'), snap(11, "s", "https://h.example/j", 4, summary='{"b":[1,2],"a":1}'), snap(12, "s", "https://h.example/k?id=1", 3, summary='{"a":1}'), snap(13, "s", "https://h.example/k?utm_x=1&id=1", 4, summary='{"a":2}'),
        snap(14, "t", "https://h.example/A", 1), snap(15, None, "u", 1), snap(16, "s", None, 1), snap(17, "s", "u", None), snap(18, "one", "u", 7), snap(19, "s", "https://h.example/A", 4, at=None),
    ]
    got = {(r["source"], r["url"], r["sweep_no"], r["change_kind"]) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()}
    h = "https://h.example"
    assert got == {("s", f"{h}/gone", 3, "removed"), ("s", f"{h}/gone", 4, "added"), ("s", f"{h}/new", 3, "added"), ("s", f"{h}/j", 3, "added"), ("s", f"{h}/k?id=1", 3, "added"), ("s", f"{h}/k?id=1", 4, "changed"), ("s", f"{h}/b", 4, "removed")}
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0


MSG = "landing_no long, dedupe_key string, reason string, attempted_at timestamp, _k0 string, _order int, _best string"


def brute_messages(rows):
    best, kept = {}, []
    for n, k, r, at, *_ in rows:
        if n is None or k is None or r is None or not k.strip() or not r.strip():
            continue
        key = (k.strip().lower(), r.strip().lower())
        best.setdefault(key, []).append((at is None, at or T0, n))
        kept.append(n)
    return sorted(set(kept) - {min(v)[2] for v in best.values()})


def test_message_store(spark):
    rng = random.Random(1)
    keys = ["Ab", " ab\t", "cd", "", None, "ef ", "EF", " x"]
    rows = [(i, rng.choice(keys), rng.choice(["r", " R", None, "q"]), rng.choice([None, T0, T0 + timedelta(seconds=rng.randrange(3))]), "x", 1, "y") for i in range(400)]
    rows += [(1000 + i, "hot", "r", None, "x", 1, "y") for i in range(500)] + [(None, "hot", "r", T0, "", 0, "")]
    df = spark.createDataFrame(rows, MSG)
    store = MessageStore(spark, ["dedupe_key", "reason"], "attempted_at", "landing_no", 3)
    store.upsert(df.where("landing_no < 150")).upsert(df.where("landing_no >= 100 or landing_no is null"))
    want = brute_messages(rows)
    assert sorted(r[0] for r in store.surplus(df).collect()) == want
    before = sorted(map(tuple, store.kept().collect()))
    store.compact()
    assert sorted(map(tuple, store.kept().collect())) == before and "Exchange" not in store.kept()._jdf.queryExecution().executedPlan().toString()
    store.upsert(df.where("landing_no < 300")).compact()  # a batch once more, in another order
    assert sorted(map(tuple, store.kept().collect())) == before and sorted(r[0] for r in store.surplus(df).collect()) == want
    store.drop()
    empty = MessageStore(spark, ["dedupe_key", "reason"], "attempted_at", "landing_no", 2).upsert(df.limit(0))
    assert empty.surplus(df.limit(0)).count() == 0
    batched = df.withColumn("batch_no", F.col("landing_no") % 9)
    for n in (1, 4, 20):
        assert sorted(r[0] for r in deduplicated(batched, ["dedupe_key", "reason"], "attempted_at", "landing_no", "batch_no", n).collect()) == want
    assert deduplicated(batched.limit(0), ["dedupe_key", "reason"], "attempted_at", "landing_no", "batch_no").count() == 0


def test_compaction_merges_sorted_runs(spark):
    """The merge of two runs neither shuffles nor sorts: it joins them bucket by bucket as they lie."""
    df = spark.createDataFrame([(i, f"k{i % 50}", "r", T0, "", 0, "") for i in range(200)], MSG)
    store = MessageStore(spark, ["dedupe_key", "reason"], "attempted_at", "landing_no", 3)
    store.upsert(df.where("landing_no < 120")).upsert(df.where("landing_no >= 80"))
    was = spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        merged = store.merged(*[store._table(r) for r in store.runs()])
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", was)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert sorted(r["_order"] for r in merged.collect()) == list(range(50))


def test_store_is_found_again_and_survives_crashes(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}", "r", T0 + timedelta(seconds=-i), "", 0, "") for i in range(60)], MSG)
    opened = lambda: MessageStore(spark, ["dedupe_key", "reason"], "attempted_at", "landing_no", 2, name="again")
    store = opened()
    store.upsert(df.where("landing_no < 30"))
    for run in store.runs():  # another application has its own catalog
        spark.sql(f"drop table {run}")
    later = opened()
    assert later.buckets == 2 and sorted(r["_order"] for r in later.kept().collect()) == list(range(23, 30))
    reader = later.kept()
    later.upsert(df.where("landing_no >= 30"))
    want = list(range(53, 60))
    assert sorted(r["_order"] for r in later.kept().collect()) == want
    commit, later._commit = later._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        later.compact()  # dies between the merge and the swap
    assert sorted(r["_order"] for r in opened().kept().collect()) == want and len(opened().runs()) == 2
    with pytest.raises(RuntimeError):
        later.upsert(df)  # dies between the write and the swap
    later._commit = commit
    stale = later.manifest()
    opened().upsert(df.where("landing_no = 0")).compact()
    assert sorted(r["_order"] for r in opened().kept().collect()) == want and len(opened().runs()) == 1
    with pytest.raises(RuntimeError):
        later._commit(stale, [])  # somebody else was first
    assert sorted(r["_order"] for r in reader.collect()) == list(range(23, 30))  # a reader keeps what it opened
    opened().vacuum()
    assert sorted(r["_order"] for r in opened().kept().collect()) == want
    with pytest.raises(ValueError, match="key"):
        MessageStore(spark, ["dedupe_key"], "attempted_at", "landing_no", name="again")
    opened().drop()


RUN = "id string, collector_name string, started_at timestamp, landed_at timestamp, candidates_found int, http_failures int, http_requests int, pages_fetched int, k string, ts long, bad string, spike int"


def brute_spikes(rows):
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in RUN.split(", ")]).dropna(subset=["id"])
    df = df.sort_values("landed_at", na_position="last").drop_duplicates("id")
    c, f, r, p = (df[x] for x in ("candidates_found", "http_failures", "http_requests", "pages_fetched"))
    out = {"implausible": set(df[(c < 0) | (f < 0) | (f > r) | ((c > 0) & (p == 0))]["id"]), "stuck": set(), "spike": set()}
    df = df.dropna(subset=["started_at"]).assign(k=df["collector_name"].fillna("").str.strip().str.lower()).sort_values(["k", "started_at", "id"])
    for _, g in df.groupby("k"):
        for s in ("candidates_found", "http_failures"):
            x = g[s].to_numpy(float)
            ids = g["id"].to_numpy()
            for i in range(len(x)):
                m = np.nanmedian(x[max(0, i - HALO) : i + HALO + 1]) if not np.isnan(x[max(0, i - HALO) : i + HALO + 1]).all() else np.nan
                if x[i] > 4 * m and x[i] >= m + 20:
                    out["spike"].add(ids[i])
            i = 0
            while i < len(x):
                j = i
                while j < len(x) and x[j] == x[i]:
                    j += 1
                j = max(j, i + 1)
                if j - i >= STUCK and x[i] != 0 and not np.isnan(x[i]):
                    out["stuck"] |= set(ids[i:j])
                i = j
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_spikes_of_a_bursty_collector(spark, partitions):
    """Runs 4 times above a median of 100, from which runs usually differ by 80: the residual is under the threshold."""
    c = [20 if i % 4 == 0 else 180 if i % 4 == 1 else 100 + (-1) ** (i // 2) * 80 * (i % 4 == 2) for i in range(400)]
    for at in (103, 211, 307):
        c[at] = 401
    rows = [(f"r{i}", "bursty", T0 + timedelta(minutes=30 * i), T0, x, 0, 100, 50, "x", 1, "y", 0) for i, x in enumerate(c)]
    got = metric_spikes(spark.createDataFrame(rows, RUN), partitions).toPandas()
    assert set(got[got["spike"]]["id"]) == brute_spikes(rows)["spike"] == {"r103", "r211", "r307"}


@pytest.mark.parametrize("partitions", [1, 7])
def test_metric_spikes_against_brute_force(spark, partitions):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for name, size, level in (("hot", 900, 60), ("b", 130, 5), ("tiny", 8, 40), ("one", 1, 3)):
        c, f = rng.poisson(level * (1 + 0.5 * np.sin(np.arange(size) / 4))), rng.poisson(2, size)
        for at in rng.integers(0, size, size // 60):
            c[at : at + 2] = c[at : at + 2] * 9 + 200
            f[(at * 7) % size] = 90
        if size > 100:
            c[50:70] = 17
            f[size - 30 : size - 15] = 3
        for i in range(size):
            ci, fi = int(c[i]), int(f[i])
            if i % 97 == 5:
                ci = -1 if i % 2 else ci
            rows.append((f"r{n}", [name, name.upper() + " ", " " + name][n % 3], T0 + timedelta(minutes=30 * i), T0 + timedelta(days=n % 5), ci if i % 41 else None, fi if i % 43 else None, 100, 0 if i % 101 == 7 else 50, "x", 1, "y", 0))
            n += 1
    rows += rows[:40] + [("late", None, None, None, -5, None, 1, 1, "", 0, "", 0), (None, "hot", T0, T0, -5, 0, 1, 1, "", 0, "", 0), ("t1", "tie", T0, T0, 5, 1, 9, 9, "", 0, "", 0), ("t2", "tie", T0, T0, 500, 1, 9, 9, "", 0, "", 0)]
    got = metric_spikes(spark.createDataFrame(rows, RUN), partitions).toPandas()
    assert got["id"].is_unique
    want = brute_spikes(rows)
    for kind in want:
        assert set(got[got[kind]]["id"]) == want[kind], kind
    assert want["spike"] and want["stuck"] and want["implausible"]
    assert metric_spikes(spark.createDataFrame([], RUN)).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_cutoff_honours_the_risk_and_spikes_do_not_hide(spark, partitions):
    """Two collectors alike in their usual runs, of which one has spikes that outnumber its other excesses: the spikes leave its cutoff where it is."""
    rng = np.random.default_rng(11)
    usual = rng.poisson(30, 1500) + (rng.random(1500) < 0.12) * (20 + rng.exponential(10, 1500)).astype(int)
    spiked = usual.copy()
    spiked[::14] = 4000
    rows = [(f"{n}{i}", n, T0 + timedelta(minutes=30 * i), T0, int(x), 0, 9000, 50, "x", 1, "y", 0) for n, xs in (("calm", usual), ("spiky", spiked)) for i, x in enumerate(xs)]
    rows += [("lone", "lone", T0, T0, 3, 0, 9, 9, "", 0, "", 0), ("none", "empty", T0, T0, None, None, None, None, "", 0, "", 0)]
    df = spark.createDataFrame(rows, RUN)
    t = {(r["collector_name"], r["series"]): r for r in tails(df, partitions).collect()}
    calm, spiky = t["calm", "candidates_found"], t["spiky", "candidates_found"]
    assert spiky["spikes"] == spiky["both"] == 108 and spiky["spikes"] > 0.5 * spiky["excesses"]
    assert calm["cutoff"] > THRESHOLD and abs(spiky["cutoff"] - calm["cutoff"]) < 0.7
    assert abs(calm["beyond_cutoff"] - calm["spikes"] - RISK * calm["runs"]) < 0.02 * calm["runs"]
    assert t["lone", "http_failures"]["cutoff"] == THRESHOLD and t["lone", "http_failures"]["shape"] is None and len(t) == 8
    assert tails(df.limit(0)).count() == 0
    got = metric_spikes(df, partitions)
    assert got.where("spike and extreme and id like 'spiky%'").count() == 108


@pytest.mark.parametrize("partitions", [1, 7])
def test_cases_are_found_without_tails(spark, partitions, tmp_path, monkeypatch):
    """A case is told by the rule, run lengths and readings: p3_found judges no residual, sums and keeps nothing for tails, and has the same rows as with them."""
    rng = np.random.default_rng(5)
    rows = []
    for name, size in (("wide", 400), ("calm", 300), ("tiny", 6)):
        c, f = rng.poisson(30, size), rng.poisson(2, size)
        if name == "wide":  # runs 4 times above a median of 100 lie under the tails' threshold
            c = np.array([20 if i % 4 == 0 else 180 if i % 4 == 1 else 100 + (-1) ** (i // 2) * 80 * (i % 4 == 2) for i in range(size)])
            c[[103, 211, 307]] = 401
        f[size // 2] = 60
        c[-15:], f[3] = (9, 101) if size > 100 else (c[-1], f[3])
        rows += [(f"{name}{i}", name, T0 + timedelta(minutes=30 * i), T0, int(c[i]) if i % 41 else None, int(f[i]) if i % 43 else None, 100, 0 if i == 71 else 50, "x", 1, "y", 0) for i in range(size)]
    rows += [(f"quiet{i}", "quiet", T0 + timedelta(minutes=30 * i), T0, 30 + i % 2, i % 3, 100, 50, "x", 1, "y", 0) for i in range(300)]  # no case at any end of its partitions
    rows += rows[:50] + [("late", None, None, None, -5, None, 1, 1, "", 0, "", 0), ("fine", None, None, None, 5, None, 1, 1, "", 0, "", 0)]
    df, want = spark.createDataFrame(rows, RUN), brute_spikes(rows)
    got = metric_spikes(df, partitions, extremes=False)
    assert got.columns == ["id", "implausible", "stuck", "spike"]
    got = got.toPandas()
    assert got["id"].is_unique and want["spike"] >= {"wide103", "wide211", "wide307"} and want["stuck"] and want["implausible"]
    for kind in want:
        assert set(got[got[kind]]["id"]) == want[kind], kind
    assert set(got["id"]) == set().union(*want.values()) == {r["id"] for r in metric_spikes(df, partitions).collect()}
    assert metric_spikes(df.limit(0), extremes=False).count() == 0
    df.write.parquet(f"{tmp_path}/collector_run_metrics.parquet")
    tables = []

    def kept(df, name):
        tables.append(written(df, name))
        return tables[-1]

    def unused(*_):
        raise AssertionError("a stage for the tails")

    monkeypatch.setattr("sightline.operators.metric_spikes.written", kept)
    monkeypatch.setattr("sightline.operators.metric_spikes.tail_cut", unused)
    assert sorted(r["id"] for r in p3_found(spark, str(tmp_path)).collect()) == sorted(got["id"])
    assert len(tables) == 1 and not {"hour", "e_c", "e_f", "n", "s_c", "s_f"} & set(tables[0].columns)
    assert tables[0].where("kind <> 'edge' and not (implausible or stuck or spike)").count() == 0 and {r["kind"] for r in tables[0].select("kind").distinct().collect()} <= {"row", "edge"}


def test_windowed_covers_each_row_once():
    for n, chunk, part in ((5, 50, 3), (79, 60, 10), (81, 60, 7), (500, 130, 60), (1000, 10_000, 64)):
        df = pd.DataFrame({"k": np.repeat("ab", n)[:n].astype(object), "x": np.arange(n)})
        seen, rim = [], set()
        for rows, edge in windowed(iter([df.iloc[i : i + part].reset_index(drop=True) for i in range(0, n, part)]), "k", 20, lambda d: d, chunk):
            if edge:
                rim |= set(rows[rows["_rim"]]["x"])
            else:
                seen += list(rows["x"])
        assert len(seen) == len(set(seen)) and set(seen) | rim == set(range(n)) and not set(seen) & rim


def test_local_stats_and_runs():
    x = np.array([1, 5, np.nan, 2, 2, 9.0])
    start, end = segments(np.array(["a"] * 4 + ["b"] * 2, object))
    assert list(start) == [0, 0, 0, 0, 4, 4] and list(end) == [4, 4, 4, 4, 6, 6]
    assert list(local_stats(x, start, end, 1, 1)[0]) == [3, 3, 3.5, 2, 5.5, 5.5] and list(local_stats(x, start, end, 2, 0)[0]) == [1, 3, 3, 3.5, 2, 5.5]
    assert list(same_run(x, start, end)) == [1, 1, 1, 1, 1, 1] and list(same_run(np.array([2, 2, 2.0]), np.zeros(3, int), np.full(3, 3))) == [3, 3, 3]
