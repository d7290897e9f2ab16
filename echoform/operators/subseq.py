"""Normalisation, length ranges, enumeration of subsequences and their buckets."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoform.functions import kernels as K

SCHEMES = ("dss", "series", "chunk", "single")


def scale_of(series: DataFrame) -> tuple[float, float]:
    """(least, greatest) of all samples: two numbers; (0, 0) without samples."""
    r = series.agg(F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi")).first()
    return (0.0, 0.0) if r.lo is None else (float(r.lo), float(r.hi))


def normalised(series: DataFrame, low: float, high: float) -> DataFrame:
    return series.withColumn("norm", K.minmax(F.col("values"), low, high))


def resolve_lengths(loi, longest: int) -> tuple[int, int]:
    """Length range of a build: None for all, (a,) from a on, (a, b); b is clamped to the longest."""
    if loi is None:
        return 1, longest
    if not isinstance(loi, Iterable) or isinstance(loi, str) or len(loi := list(loi)) not in (1, 2):
        raise ValueError("length of interest must be an iterable of length one or two")
    lo, hi = int(loi[0]), int(loi[1]) if len(loi) == 2 else longest
    if lo < 1 or hi < 1:
        raise ValueError("length of interest must be at least 1")
    if hi < lo:
        raise ValueError("length of interest ends before it starts")
    if lo > longest:
        raise ValueError(f"length of interest starts above the longest series ({longest})")
    if hi > longest:
        warnings.warn(f"length of interest clamped to the longest series ({longest})", stacklevel=2)
    return lo, min(hi, longest)


def resolve_query_lengths(loi, built: tuple[int, int]) -> tuple[int, int]:
    """Length range of a query: within the build's; its start must not be below."""
    if loi is None:
        return built
    lo, hi = resolve_lengths(loi, max(built[1], int(list(loi)[0])))
    if lo < built[0]:
        raise ValueError(f"length of interest starts below the build's ({built[0]})")
    return lo, min(hi, built[1])


def bucket_of(scheme: str, n_buckets: int, n_series: int) -> Column:
    """The bucket a subsequence is clustered in. dss: starts of a series are dealt out in
    turn; series: contiguous ranges of series; chunk: whole chunks of floor(n / buckets)
    series; single: one bucket."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}: choose one of {', '.join(SCHEMES)}")
    t, p = F.col("ts_idx"), F.lit(n_buckets)
    if scheme == "dss":
        return F.pmod(F.col("start") - t, p).cast("int")
    if scheme == "series":
        return F.floor(t * p / max(n_series, 1)).cast("int")
    if scheme == "chunk":
        return F.floor(t / (n_series if n_series < n_buckets else max(n_series // n_buckets, 1))).cast("int")
    return F.lit(0)


def enumerate_windows(series: DataFrame, lo: int, hi: int, scheme: str = "dss", n_buckets: int = 8, n_series: int = 0, data: str | None = "norm") -> DataFrame:
    """All windows of lo to hi samples: series_id, ts_idx, start, end (inclusive), len,
    bucket, and their samples from column ``data`` unless None. Expansion happens by
    generators after column pruning; nothing is shuffled."""
    keep = [c for c in ("series_id", "ts_idx", "features") if c in series.columns]
    out = series.where(F.col("n") >= lo).select(*keep, "n", *([data] if data else []))
    out = out.withColumn("len", F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("n")))))
    out = out.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))))
    cols = [*keep, "start", (F.col("start") + F.col("len") - 1).alias("end"), "len", bucket_of(scheme, n_buckets, n_series).alias("bucket")]
    return out.select(*cols, *([K.window(F.col(data), F.col("start"), F.col("len")).alias("data")] if data else []))


def with_data(pointers: DataFrame, series: DataFrame, column: str = "norm") -> DataFrame:
    """Attach the samples of (series_id, start, len) pointers."""
    return pointers.join(series.select("series_id", F.col(column).alias("_all")), "series_id").withColumn("data", K.window(F.col("_all"), F.col("start"), F.col("len"))).drop("_all")


def exists(pointers: DataFrame, series: DataFrame) -> DataFrame:
    """Pointers whose series exists and whose bounds lie inside it."""
    return pointers.join(series.select("series_id", "n"), "series_id").where((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") < F.col("n"))).drop("n")


def closest_length(lengths: DataFrame, n: int) -> DataFrame:
    """The length nearest to n, the smaller of two as near."""
    return lengths.agg(F.min_by("len", F.struct(F.abs(F.col("len") - n), F.col("len"))).alias("len"))


def lengths_within(lengths: DataFrame, n: int, radius: int) -> DataFrame:
    return lengths.where(F.abs(F.col("len") - n) <= radius)
