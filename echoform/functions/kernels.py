"""Distances, bounds, compression and overlap as Column expressions (no Python in the plan)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("eu", "ma", "ch", "min")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown distance {metric!r}: choose one of {', '.join(METRICS)}")
    return metric


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def distance(x: Column, y: Column, metric: str) -> Column:
    """Distance of equally long arrays, without warping: normalised Euclidean (eu) and
    Manhattan (ma), or the largest difference (ch, min)."""
    check_metric(metric)
    if metric == "eu":
        return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))) / F.size(x))
    gaps = F.zip_with(x, y, lambda a, b: F.abs(a - b))
    return _sum(gaps) / F.size(x) if metric == "ma" else F.array_max(gaps)


def warped(total: Column, n: Column, m: Column, metric: str) -> Column:
    """Normalise a warping cost of arrays of n and m samples."""
    check_metric(metric)
    return F.sqrt(total / (n + m)) if metric == "eu" else total / (n + m) if metric == "ma" else total


def dtw(x: Column, y: Column, metric: str) -> Column:
    """Exact dynamic time warping with cost |a - b|, as nested aggregates: one row of the
    cost table per sample of x."""
    inf = F.lit(float("inf"))
    first = F.transform(F.sequence(F.lit(0), F.size(y)), lambda i: F.when(i == 0, F.lit(0.0)).otherwise(inf))

    def step(row: Column, a: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            best = F.least(F.element_at(new, -1), F.element_at(row, j), F.element_at(row, j + 1))
            return F.array_append(new, best + F.abs(a - F.element_at(y, j)))

        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(inf), cell)

    return warped(F.element_at(F.aggregate(x, first, step), -1), F.size(x), F.size(y), metric)


def dtw_floor(x: Column, y: Column, metric: str) -> Column:
    """A bound that never exceeds the warped distance: both ends are on the path, and each
    extreme is matched with something not beyond the other's."""
    ends = F.abs(F.element_at(x, 1) - F.element_at(y, 1)) + F.when((F.size(x) > 1) | (F.size(y) > 1), F.abs(F.element_at(x, -1) - F.element_at(y, -1))).otherwise(0.0)
    least = F.greatest(ends, F.abs(F.array_max(x) - F.array_max(y)), F.abs(F.array_min(x) - F.array_min(y)))
    return warped(least, F.size(x), F.size(y), metric)


def lb_kim(x: Column, y: Column) -> Column:
    """Half the root of the squared differences of first and last samples (a heuristic for eu and ma)."""
    a, b = F.element_at(x, 1) - F.element_at(y, 1), F.element_at(x, -1) - F.element_at(y, -1)
    return F.sqrt(a * a + b * b) / 2


def lb_keogh(x: Column, envelope_of: Column, radius: int = 1) -> Column:
    """Root of the squared excess of x over the other's envelope, divided by the length; null for unequal lengths."""
    n = F.size(x)

    def excess(v: Column, i: Column) -> Column:
        lo = F.greatest(i + 1 - radius, F.lit(1))
        near = F.slice(envelope_of, lo, F.least(i + 1 + radius, n) - lo + 1)
        over = F.greatest(v - F.array_max(near), F.array_min(near) - v, F.lit(0.0))
        return over * over

    return F.when(n == F.size(envelope_of), F.sqrt(_sum(F.transform(x, excess))) / n)


def paa(x: Column, segments: int) -> Column:
    """Means of equal segments, as many as asked for or as there are samples; a tail that
    fills no segment is left out."""
    s = F.least(F.size(x), F.lit(segments))
    w = F.floor(F.size(x) / s).cast("int")
    return F.transform(F.sequence(F.lit(0), s - 1), lambda i: _sum(F.slice(x, i * w + 1, w)) / w)


def breakpoints(symbols: int) -> list[float]:
    """Cuts of the standard normal law into equally likely parts."""
    return [NormalDist().inv_cdf(i / symbols) for i in range(1, symbols)]


def sax(x: Column, segments: int, standardise: bool = False) -> Column:
    """Symbols 0.. of the PAA means, in an alphabet of 2**segments."""
    cuts = F.lit(breakpoints(2**segments)) if segments > 0 else F.array()
    return F.transform(paa(znorm(x) if standardise else x, segments), lambda v: F.size(F.filter(cuts, lambda c: c <= v)))


def mean(x: Column) -> Column:
    return _sum(x) / F.size(x)


def znorm(x: Column) -> Column:
    """(x - mean) / population deviation; zeros where the deviation is 0."""
    mu = mean(x)
    sd = F.sqrt(_sum(F.transform(x, lambda v: (v - mu) * (v - mu))) / F.size(x))
    return F.transform(x, lambda v: F.when(sd > 0, (v - mu) / sd).otherwise(0.0))


def minmax(x: Column, low: float, high: float) -> Column:
    """Samples on the scale where low is 0 and high is 1; zeros where both are equal."""
    span = high - low
    return F.transform(x, lambda v: (v - low) / span if span else F.lit(0.0))


def inverse_minmax(x: Column, low: float, high: float) -> Column:
    return F.transform(x, lambda v: v * (high - low) + low)


def resample(x: Column, n: int | Column) -> Column:
    """Linear interpolation of x to n samples over the same span."""
    m = F.size(x)

    def at(i: Column) -> Column:
        p = i * (m - 1) / F.greatest(F.lit(n) - 1 if isinstance(n, int) else n - 1, F.lit(1))
        lo = F.floor(p).cast("int")
        hi = F.least(lo + 1, m - 1)
        return F.element_at(x, lo + 1) + (F.element_at(x, hi + 1) - F.element_at(x, lo + 1)) * (p - lo)

    return F.transform(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1), at)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Signed Jaccard of two inclusive windows: 1 when equal, 0 when touching, negative when apart."""
    return (F.least(e1, e2) - F.greatest(s1, s2) + 1) / (F.greatest(e1, e2) - F.least(s1, s2) + 1)


def overlaps(id1: Column, s1: Column, e1: Column, id2: Column, s2: Column, e2: Column, least: float) -> Column:
    return (id1 == id2) & ((overlap(s1, e1, s2, e2) >= least) | ((s1 == s2) & (e1 == e2)))


def window(data: Column, start: Column, length: Column) -> Column:
    """Samples of a 0-based window."""
    return F.slice(data, start + 1, length)


def sub_window(start: Column, end: Column, first: int | None, stop: int | None) -> tuple[Column, Column]:
    """A window inside a window: ``first`` moves the start on, a negative ``stop`` the end back."""
    if (first or 0) < 0 or (stop or 0) > 0:
        raise IndexError("the inner window must lie within the outer one")
    return start + (first or 0), end + (stop or 0)


def name_of(series_id: Column, start: Column, end: Column) -> Column:
    """``(id1)_(id2): (start:end)len=n`` with blanks as dashes."""
    label = F.concat(F.lit("("), F.regexp_replace(series_id, r"\|", ")_("), F.lit(")"))
    return F.regexp_replace(F.format_string("%s: (%d:%d)len=%d", label, start, end, end - start + 1), r"(?<!:) {1,2}", "-")
