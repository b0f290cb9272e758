"""Percentiles of very large numeric columns (problem 2): deterministic rank-interval summaries that merge, with a certified rank error."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.metric_spikes import runs_of

#: The rank error allowed, as a share of a group's values.
EPSILON = 0.005
#: Levels at which a summary may be compressed on its way; each may add its part of EPSILON.
LEVELS = 4
#: Summaries of one group that a task merges at once.
FAN_IN = 64

METRICS = {"duration_ms": "d", "candidates_found": "c"}
PERCENTILES = (0.5, 0.9, 0.95, 0.99)
SUMMARY = "k string, metric string, day int, n long, v array<double>, lo array<long>, hi array<long>"


class Summaries:
    """Rank-interval tuples of several groups, one after another: of a value v, `lo` is at most the number of values <= v, `hi` at least the number < v.

    size: tuples in each group; n: values in each group. The least and the greatest value are always kept, so any rank lies between tuples.
    """

    def __init__(self, size: np.ndarray, n: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.size, self.n, self.v, self.lo, self.hi = size, n, v, lo, hi

    @property
    def start(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if len(self.size) else np.zeros(0, np.int64)

    @staticmethod
    def of_values(group: np.ndarray, value: np.ndarray, groups: int) -> Summaries:
        """Exact summaries of values: every distinct value of a group with its ranks."""
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        new = np.ones(len(v), bool)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        n = np.bincount(g, minlength=groups)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        below = at - first[g[at]]
        upto = np.concatenate([at[1:], [len(v)]]) - first[g[at]] if len(at) else at
        return Summaries(np.bincount(g[at], minlength=groups), n, v[at], upto, below)

    def merged(self, into: np.ndarray, groups: int) -> Summaries:
        """The summaries of groups put together: into[i] is the group that summary i goes to. Bounds on ranks add up, so no error is added.

        Of each summary, `lo` is a step function that rises at its values, `hi` one that rises just after them; the sums' steps are the steps of all.
        """
        owner = np.repeat(np.arange(len(self.size)), self.size)
        first, last = np.zeros(len(self.v), bool), np.zeros(len(self.v), bool)
        some = self.size > 0
        first[self.start[some]] = True
        last[(self.start + self.size - 1)[some]] = True
        rise = self.lo.copy()
        rise[1:] -= np.where(first[1:], 0, self.lo[:-1])
        later = np.empty_like(self.hi)
        later[:-1] = self.hi[1:]
        later[last] = self.n[owner[last]]
        later = later - self.hi
        g = into[owner]
        order = np.lexsort((self.v, g))
        g, v, rise, later = g[order], self.v[order], rise[order], later[order]
        base = np.bincount(into[owner[first]], weights=self.hi[first], minlength=groups).astype(np.int64)
        n = np.bincount(into, weights=self.n, minlength=groups).astype(np.int64)
        if not len(v):
            return Summaries(np.zeros(groups, np.int64), n, v, rise, later)
        new = np.ones(len(v), bool)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        up, on = np.cumsum(rise), np.cumsum(later)
        head = np.searchsorted(g, np.arange(groups))
        before_up = np.where(head > 0, up[np.maximum(head - 1, 0)], 0)
        before_on = np.where(head > 0, on[np.maximum(head - 1, 0)], 0)
        stop = np.concatenate([at[1:], [len(v)]]) - 1
        gg = g[at]
        lo = up[stop] - before_up[gg]
        hi = base[gg] + np.where(at > 0, on[np.maximum(at - 1, 0)], 0) - before_on[gg]
        return Summaries(np.bincount(gg, minlength=groups), n, v[at], lo, hi)

    def pruned(self, keep: int) -> Summaries:
        """At most keep + 2 tuples a group: one for each of `keep` equal stretches of ranks, beside the first and the last."""
        if not len(self.v):
            return self
        owner = np.repeat(np.arange(len(self.size)), self.size)
        middle = (self.lo + self.hi + 1) / 2
        cell = np.floor((middle - 1) / np.maximum(self.n[owner] - 1, 1) * keep).astype(np.int64)
        hold = np.ones(len(self.v), bool)
        hold[1:] = (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])
        hold[(self.start + self.size - 1)[self.size > 0]] = True
        hold |= (self.size <= keep)[owner]
        return Summaries(np.bincount(owner[hold], minlength=len(self.size)), self.n, self.v[hold], self.lo[hold], self.hi[hold])

    def ask(self, i: int, p: float) -> tuple[float, int]:
        """Of group i, a value for the p-th part (nearest rank: the ceil(p * n)-th of n) and how many ranks it may be off."""
        a, b = self.start[i], self.start[i] + self.size[i]
        r = min(max(int(np.ceil(p * self.n[i] - 1e-9)), 1), int(self.n[i]))
        off = np.maximum(np.maximum(r - self.lo[a:b], self.hi[a:b] + 1 - r), 0)
        j = int(np.argmin(off))
        return float(self.v[a + j]), int(off[j])

    def lists(self) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.size)]).astype(np.int32))
        return tuple(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (self.v.astype(float), self.lo.astype(np.int64), self.hi.astype(np.int64)))

    @staticmethod
    def from_lists(n: pa.Array, v: pa.Array, lo: pa.Array, hi: pa.Array) -> Summaries:
        size = np.diff(np.asarray(v.offsets)).astype(np.int64)
        return Summaries(size, np.asarray(n), *(np.asarray(x.flatten(), dtype) for x, dtype in ((v, float), (lo, np.int64), (hi, np.int64))))


def _rows(k: list, metric: list, day: list, s: Summaries) -> pa.RecordBatch:
    v, lo, hi = s.lists()
    return pa.record_batch([pa.array(k, pa.string()), pa.array(metric, pa.string()), pa.array(day, pa.int32()), pa.array(s.n, pa.int64()), v, lo, hi], names=["k", "metric", "day", "n", "v", "lo", "hi"])


def _summarise(batches: Iterator[pa.RecordBatch], keep: int, rows: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Summaries of (collector, metric, day) over stretches of a partition."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        code = t["k"].combine_chunks().dictionary_encode()
        names, k = code.dictionary.to_pylist(), np.asarray(code.indices).astype(np.int64)
        day = np.asarray(t["day"].fill_null(-(2**31))).astype(np.int64)
        for metric, column in METRICS.items():
            x = np.asarray(t[column].combine_chunks(), float)
            ok = ~np.isnan(x) & (x >= 0)
            if not ok.any():
                continue
            both, group = np.unique(np.stack([k[ok], day[ok]]), axis=1, return_inverse=True)
            s = Summaries.of_values(group.ravel(), x[ok], both.shape[1]).pruned(keep)
            yield _rows([names[i] for i in both[0]], [metric] * both.shape[1], [None if d == -(2**31) else int(d) for d in both[1]], s)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from made(held)
            held, n = [], 0
    if n:
        yield from made(held)


def _merge(batches: Iterator[pa.RecordBatch], keep: int, by_day: bool) -> Iterator[pa.RecordBatch]:
    """Merges the summaries of equal groups in a partition sorted by group. A group with very many is merged FAN_IN at a time, level by level."""

    def key(t: pa.Table) -> np.ndarray:
        parts = [t["k"], t["metric"]] + ([t["day"].cast(pa.string()).fill_null("")] if by_day else [])
        import pyarrow.compute as pc

        return np.asarray(pc.binary_join_element_wise(*parts, "\x1f").combine_chunks().dictionary_encode().indices)

    def collapse(t: pa.Table) -> pa.RecordBatch:
        g = key(t)  # in order of appearance, which is the sort order
        groups = int(g.max()) + 1
        s = Summaries.from_lists(*(t[c].combine_chunks() for c in ("n", "v", "lo", "hi"))).merged(g.astype(np.int64), groups).pruned(keep)
        first = np.searchsorted(g, np.arange(groups))
        head = t.select(["k", "metric", "day"]).take(pa.array(first))
        day = head["day"].to_pylist() if by_day else [None] * groups
        return _rows(head["k"].to_pylist(), head["metric"].to_pylist(), day, s)

    def last_group(t: pa.Table) -> int:
        g = key(t)
        return int(np.searchsorted(g, g[-1]))

    held: pa.Table | None = None
    levels: list[list[pa.Table]] = []  # partial merges of the group that is still open

    def push(t: pa.Table, level: int) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(t)
        if len(levels[level]) >= FAN_IN:
            all_of = pa.concat_tables(levels[level])
            levels[level] = []
            push(pa.Table.from_batches([collapse(all_of)]), level + 1)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 20_000:
            continue
        at = last_group(held)
        if at:
            done = held.slice(0, at)
            if any(levels):
                done = pa.concat_tables([*(x for level in levels for x in level), done])
                levels = []
            yield collapse(done)
            held = held.slice(at)
        else:
            push(pa.Table.from_batches([collapse(held)]), 0)
            held = None
    rest = [*(x for level in levels for x in level), *([held] if held is not None else [])]
    if rest:
        yield collapse(pa.concat_tables(rest))


def daily_summaries(metrics: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """k, metric, day, n, v, lo, hi: a mergeable summary of each collector's readings on each day, each run once; `day` counts from 1970-01-01.

    Each task sums up its part of the runs; summaries of a group are then merged. Readings that are null or negative are left out, zeros count.
    Runs without a start are a day of their own (null); runs of a null collector are those of the collector ''. An empty table gives no rows.
    """
    keep = int(np.ceil(LEVELS / (2 * epsilon)))
    runs = runs_of(metrics, {a: c for c, a in METRICS.items()})
    rows = runs.select("k", F.floor(F.col("ts") / 86_400_000_000).cast("int").alias("day"), "d", "c")
    local = rows.mapInArrow(partial(_summarise, keep=keep), SUMMARY)
    n = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return local.repartition(n, "k", "metric", "day").sortWithinPartitions("k", "metric", "day").mapInArrow(partial(_merge, keep=keep, by_day=True), SUMMARY)


def combined(summaries: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Summaries over any set of days (or of parts of the data) merged into one of each collector and metric."""
    keep = int(np.ceil(LEVELS / (2 * epsilon)))
    n = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return summaries.repartition(n, "k", "metric").sortWithinPartitions("k", "metric").mapInArrow(partial(_merge, keep=keep, by_day=False), SUMMARY)


def _ask(batches: Iterator[pa.RecordBatch], ps: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = Summaries.from_lists(*(b.column(c) for c in ("n", "v", "lo", "hi")))
        got = [(k, m, p, *s.ask(i, p), n) for i, (k, m, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("k", "metric", "n")), strict=True)) for p in ps]
        names = ["collector_name", "metric", "percentile", "value", "rank_error", "n_values"]
        types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array([x[i] for x in got], t) for i, t in enumerate(types)], names=names)


def percentiles(summaries: DataFrame, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """collector_name, metric, percentile, value, rank_error, n_values: the value's rank is at most rank_error off ceil(percentile * n_values)."""
    return summaries.mapInArrow(partial(_ask, ps=ps), "collector_name string, metric string, percentile double, value double, rank_error long, n_values long")
