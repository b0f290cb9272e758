from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from sightline.llm.quantiles import METRICS, Summaries, combined, daily_summaries, percentiles


def off(values, value, p):
    a = np.sort(values)
    r = max(1, int(np.ceil(p * len(a) - 1e-9)))
    lt, le = np.searchsorted(a, value, "left"), np.searchsorted(a, value, "right")
    assert le > lt
    return max(r - le, lt + 1 - r, 0)


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "one", "sorted"])
def test_bounds_hold_through_merges(kind):
    rng = np.random.default_rng(4)
    draw = {"normal": lambda n: rng.normal(size=n), "ties": lambda n: rng.integers(0, 5, n).astype(float), "heavy": lambda n: np.exp(rng.normal(size=n) * 6), "one": lambda n: np.full(n, 3.0), "sorted": lambda n: np.arange(n, dtype=float)}[kind]
    parts = [draw(int(n)) for n in rng.integers(1, 900, 40)]
    keep = 100
    level = [Summaries.of_values(np.zeros(len(x), np.int64), x, 1).pruned(keep) for x in parts]
    while len(level) > 1:
        nxt = []
        for i in range(0, len(level), 4):
            c = level[i : i + 4]
            s = Summaries(*(np.concatenate([getattr(x, f) for x in c]) for f in ("size", "n", "v", "lo", "hi")))
            nxt.append(s.merged(np.zeros(len(c), np.int64), 1).pruned(keep))
        level = nxt
    every = np.concatenate(parts)
    assert level[0].n[0] == len(every) and level[0].size[0] <= keep + 2
    for p in (0, 0.01, 0.25, 0.5, 0.9, 0.99, 1):
        value, error = level[0].ask(0, p)
        assert off(every, value, p) <= error <= 0.03 * len(every) + 1


def metrics(spark, rows):
    return spark.createDataFrame(rows, "id string, collector_name string, started_at timestamp, landed_at timestamp, duration_ms int, candidates_found int, k string, day int, v string")


def test_operator(spark):
    rng = np.random.default_rng(1)
    t0 = datetime(2020, 1, 1)
    rows = [(f"r{i}", [" Hot ", "hot", "b"][i % 3], t0 + timedelta(hours=i), t0, int(rng.integers(-5, 500)), int(rng.integers(0, 9)), "", 1, "") for i in range(3000)]
    rows += rows[:50]  # landed twice
    rows += [("n1", None, None, None, 5, None, None, None, None), ("n2", "b", None, t0, None, -3, "", 0, ""), (None, "b", t0, t0, 1, 1, "", 0, "")]
    df = metrics(spark, rows)
    days = daily_summaries(df)
    got = percentiles(combined(days)).toPandas()
    x = pd.DataFrame(rows[:3000] + rows[3050:3051], columns=["id", "k", "t", "l", "d", "c", *"123"])
    x["k"] = x["k"].fillna("").str.strip().str.lower()
    for r in got.itertuples():
        a = x[x["k"] == r.collector_name][METRICS[r.metric]].dropna().to_numpy()
        a = a[a >= 0]
        assert len(a) == r.n_values and off(a, r.value, r.percentile) <= r.rank_error <= 0.005 * r.n_values + 1
    assert set(got["collector_name"]) == {"hot", "b", ""} and len(got) == 4 * 5
    some = days.where("day is not null and day % 2 = 0")
    assert percentiles(combined(some)).count() > 0
    assert percentiles(combined(daily_summaries(df.limit(0)))).count() == 0
