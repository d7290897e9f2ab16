"""Events inside recordings: locating them and cutting windows of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locate(values: Column, pattern: Column) -> Column:
    """0-based place of the first exact occurrence of pattern in values, null if none."""
    m, n = F.size(pattern), F.size(values)
    places = F.filter(F.when(n >= m, F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(values, i + 1, m) == pattern)
    return F.try_element_at(places, F.lit(1))


def event_start(values: Column, event: Column) -> Column:
    """Where an event's samples, but for the last two, begin."""
    return locate(values, F.slice(event, 1, F.greatest(F.size(event) - 2, F.lit(1))))


def around(values: Column, start: Column, rate: float, before: float, after: float) -> tuple[Column, Column, Column]:
    """(samples, first, one past the last) of a window of seconds around a place."""
    if before <= 0 or after <= 0:
        raise ValueError("windows must be positive")
    lo = F.greatest((start - before * rate).cast("int"), F.lit(0))
    hi = F.least((start + after * rate).cast("int"), F.size(values))
    return F.slice(values, lo + 1, F.greatest(hi - lo, F.lit(0))), lo, hi


def to_events(series: DataFrame, name: int = 1, start: int = 3, end: int = 4) -> DataFrame:
    """Series with event features -> (name, start_s, end_s, values); times come in milliseconds."""
    at = lambda i: F.element_at("features", i + 1)
    return series.select(at(name).alias("name"), (at(start).cast("double") / 1000).alias("start_s"), (at(end).cast("double") / 1000).alias("end_s"), "values")
