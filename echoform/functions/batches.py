"""Warping distances over Arrow batches: many candidates at once, grouped by length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from echoform.functions.kernels import check_metric


def normalise(total: np.ndarray, n: int, m: int, metric: str) -> np.ndarray:
    return np.sqrt(total / (n + m)) if metric == "eu" else total / (n + m) if metric == "ma" else total


def dtw_many(cands: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Warping costs of equally long candidates (rows) to a query, cost |a - b|; or each to
    its own, if the query has a column per candidate. The table runs over (candidate
    samples, query samples), all candidates side by side."""
    b, n = cands.shape
    row = np.full((n + 1, b), np.inf)
    row[0] = 0.0
    columns = np.ascontiguousarray(cands.T)
    for q in query:
        new = np.empty_like(row)
        new[0] = np.inf
        np.minimum(row[1:], row[:-1], out=row[:-1])
        gap = np.abs(columns - q)
        for j in range(n):
            np.minimum(row[j], new[j], out=new[j + 1])
            new[j + 1] += gap[j]
        row = new
    return row[n]


def dtw_fast(x: np.ndarray, y: np.ndarray, radius: int = 1) -> float:
    """Approximate cost: solve at half resolution, then within ``radius`` of the path found."""
    def solve(a: np.ndarray, b: np.ndarray, window: list[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
        cost: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {}
        for i, j in window:
            options = [(cost[p][0], p) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p in cost]
            base, origin = min(options, default=(0.0 if (i, j) == (0, 0) else np.inf, None))
            cost[i, j] = base + abs(a[i] - b[j]), origin
        path, at = [], (len(a) - 1, len(b) - 1)
        total = cost[at][0]
        while at:
            path.append(at)
            at = cost[at][1]
        return total, path[::-1]

    def descend(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
        if min(len(a), len(b)) < radius + 2:
            return solve(a, b, [(i, j) for i in range(len(a)) for j in range(len(b))])
        half = lambda v: v[: len(v) // 2 * 2].reshape(-1, 2).mean(axis=1)
        _, path = descend(half(a), half(b))
        near = {(i + di, j + dj) for i, j in path for di in range(-radius, radius + 1) for dj in range(-radius, radius + 1)}
        cells = {(2 * i + p, 2 * j + q) for i, j in near for p in (0, 1) for q in (0, 1)}
        cells |= {(len(a) - 1, j) for j in range(len(b) - 3, len(b))} | {(i, len(b) - 1) for i in range(len(a) - 3, len(a))}
        return solve(a, b, sorted((i, j) for i, j in cells if 0 <= i < len(a) and 0 <= j < len(b)))

    return float(descend(np.asarray(x, float), np.asarray(y, float))[0])


def floors(cands: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Bounds that never exceed the warped distances: ends meet ends, and each extreme is
    matched with something not beyond the other's."""
    n, m = cands.shape[1], len(query)
    ends = np.abs(cands[:, 0] - query[0]) + (np.abs(cands[:, -1] - query[-1]) if max(n, m) > 1 else 0.0)
    tops, lows = np.abs(cands.max(axis=1) - query.max()), np.abs(cands.min(axis=1) - query.min())
    return normalise(np.maximum(ends, np.maximum(tops, lows)), n, m, metric)


class KBest:
    """The k best matches seen, by (dist, series_id, start, end); ``limit`` is the k-th distance once there are k."""

    def __init__(self, k: int):
        self.k, self.rows, self.limit = k, [], np.inf

    def add(self, dist: np.ndarray, ids, starts: np.ndarray, size: int) -> None:
        near = np.flatnonzero(dist <= self.limit)
        if len(near) > self.k:
            near = near[dist[near] <= np.partition(dist[near], self.k - 1)[self.k - 1]]
        if len(near):
            new = [(float(dist[i]), ids[i], int(starts[i]), int(starts[i]) + size - 1, size) for i in near]
            self.rows = sorted(self.rows + new)[: self.k]
            self.limit = self.rows[-1][0] if len(self.rows) == self.k else np.inf

    def search(self, cands: np.ndarray, query: np.ndarray, metric: str, ids, starts: np.ndarray, prune: bool = True) -> None:
        """Warp equally long candidates (rows), but for those whose bound exceeds the limit; the least bounds go first."""
        if not len(cands):
            return
        n, m = cands.shape[1], len(query)
        if not prune:
            self.add(normalise(dtw_many(cands, query), n, m, metric), ids, starts, n)
            return
        low = floors(cands, query, metric)
        at = np.flatnonzero(low <= self.limit * (1 + 1e-12))
        at = at[np.argsort(low[at], kind="stable")]
        for part in (at[: 4 * self.k], at[4 * self.k :]):
            part = part[low[part] <= self.limit * (1 + 1e-12)]
            if len(part):
                self.add(normalise(dtw_many(cands[part], query), n, m, metric), [ids[i] for i in part], starts[part], n)


def _by_length(data: pd.Series):
    sizes = data.map(len).to_numpy() if len(data) else np.empty(0, int)
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def dtw_to(query: list[float], metric: str, mode: str = "exact"):
    """Vectorised distance Column of a data Column to one query."""
    check_metric(metric)
    q = np.asarray(query, float)

    @F.pandas_udf("double")
    def run(data: pd.Series) -> pd.Series:
        out = np.full(len(data), np.nan)
        for n, at in _by_length(data):
            rows = np.stack(data.iloc[at].to_list()).astype(float) if n else np.empty((len(at), 0))
            total = dtw_many(rows, q) if mode == "exact" else np.array([dtw_fast(r, q) for r in rows])
            out[at] = normalise(total, n, len(q), metric)
        return pd.Series(out)

    return run


def dtw_between(x: Column, y: Column, metric: str) -> Column:
    """Vectorised distance Column of two data Columns; rows of equal lengths go together."""
    check_metric(metric)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        for n, rows in _by_length(a):
            for m, at in _by_length(b.iloc[rows]):
                where = rows[at]
                own = np.stack(b.iloc[where].to_list()).astype(float)
                out[where] = normalise(dtw_many(np.stack(a.iloc[where].to_list()).astype(float), own.T), n, m, metric)
        return pd.Series(out)

    return run(x, y)
