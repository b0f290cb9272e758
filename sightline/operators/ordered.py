"""Neighbourhoods along an order, for keys of any size: each row sees its `halo` rows before and after it within its key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd


def windowed(parts: Iterator[pd.DataFrame], key: str, halo: int, judge: Callable[[pd.DataFrame], pd.DataFrame], chunk: int = 60_000) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Runs judge over one sorted partition in chunks that overlap by `halo` rows each way, so memory doesn't grow with the partition.

    Yields (judged, False) for the rows whose whole neighbourhood lies in the partition, each once, and (rows, True) for the rows as they came
    that lie within 2 * halo of the partition's ends; of those, column `_rim` marks the ones within halo, which edges() judges. A row whose key's
    rows end within the partition's interior has its whole neighbourhood; only the partition's own two ends are open.
    """
    held: pd.DataFrame | None = None  # rows not yet passed on, after up to `lead` rows kept as context
    lead, seen, first = 0, 0, []

    def step(buf: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
        return judge(buf).iloc[lo:hi]

    tail: pd.DataFrame | None = None
    for part in parts:
        if not len(part):
            continue
        if seen < 2 * halo:
            first.append(part.iloc[: 2 * halo - seen])
        seen += len(part)
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        tail = part.iloc[-2 * halo :] if tail is None or len(part) >= 2 * halo else pd.concat([tail, part], ignore_index=True).iloc[-2 * halo :]
        if len(held) >= chunk:
            start = lead if lead else halo  # the partition's first halo rows are left to edges()
            stop = len(held) - halo
            if stop > start:
                yield step(held, start, stop), False
                held = held.iloc[max(0, stop - halo) :].reset_index(drop=True)
                lead = halo
    if held is None:
        return
    start, stop = (lead if lead else halo), len(held) - halo
    if stop > start:
        yield step(held, start, stop), False
    if seen <= 4 * halo:  # first and tail overlap: the whole partition
        whole = held if not lead else pd.concat([*first, tail], ignore_index=True)
        place = np.arange(len(whole))
        yield whole.assign(_rim=(place < halo) | (place >= len(whole) - halo)), True
        return
    head = pd.concat(first, ignore_index=True)
    yield head.assign(_rim=np.arange(len(head)) < halo), True
    yield tail.assign(_rim=np.arange(len(tail)) >= len(tail) - halo), True


def segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a sorted key column, where its key's rows start and end (exclusive) in it."""
    n = len(key)
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1 if n else np.array([], int)
    bounds = np.concatenate([[0], cut, [n]]).astype(int)
    size = np.diff(bounds)
    return np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)


def _around(x: np.ndarray, start: np.ndarray, end: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Each row's neighbourhood: itself, up to `back` rows before and `ahead` after it within [start, end); NaN elsewhere."""
    at = np.arange(len(x))[:, None] + np.arange(-back, ahead + 1)[None, :]
    inside = (at >= start[:, None]) & (at < end[:, None])
    return np.where(inside, x[np.clip(at, 0, len(x) - 1)], np.nan)


def _middle(a: np.ndarray) -> np.ndarray:
    """The median of each line of a, which is sorted in place; NaN is ignored."""
    count = np.sum(~np.isnan(a), axis=1)
    a.sort(axis=1)  # NaN comes last
    i = np.maximum(count - 1, 0)
    rows = np.arange(len(a))
    return (a[rows, i // 2] + a[rows, np.minimum((i + 1) // 2, a.shape[1] - 1)]) / 2


def local_median(x: np.ndarray, start: np.ndarray, end: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Median of each row's neighbourhood (itself, up to `back` rows before and `ahead` after it within [start, end)); NaN is ignored."""
    return _middle(_around(x, start, end, back, ahead)) if len(x) else np.zeros(0)


def local_stats(x: np.ndarray, start: np.ndarray, end: np.ndarray, back: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Median, as local_median() gives it, and median distance from it, of each row's neighbourhood."""
    if not len(x):
        return np.zeros(0), np.zeros(0)
    w = _around(x, start, end, back, ahead)
    m = _middle(w)
    return m, _middle(np.abs(w - m[:, None]))


def same_run(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of successive rows with a row's own value, it included, within [start, end)."""
    n = len(x)
    if not n:
        return np.zeros(0, int)
    new = np.ones(n, bool)
    new[1:] = (x[1:] != x[:-1]) | (start[1:] != start[:-1]) | np.isnan(x[1:])
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def sorted_within(df: pd.DataFrame, by: Sequence[str]) -> pd.DataFrame:
    return df.sort_values(list(by), kind="stable", ignore_index=True)
