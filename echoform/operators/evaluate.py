"""Accuracy evaluation and query sets."""

from __future__ import annotations

import math
import random
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_error(found: DataFrame, exact: DataFrame, k: int | None = None) -> DataFrame:
    """Mean absolute difference of distances at equal query and rank, one row (error, ranks)."""
    keys = ["query_id", "rank"] if "query_id" in found.columns else ["rank"]
    both = found.select(*keys, F.col("dist").alias("d")).join(exact.select(*keys, F.col("dist").alias("t")), keys)
    both = both.where(F.col("rank") <= k) if k else both
    return both.agg(F.avg(F.abs(F.col("d") - F.col("t"))).alias("error"), F.count("*").alias("ranks"))


def length_bands(lo: int, hi: int, bands: int = 3) -> list[tuple[int, int]]:
    """The range of lengths in equal bands, ends included where they are whole."""
    step = (hi - lo) / bands
    return [(math.ceil(lo + i * step), max(math.ceil(lo + i * step), math.floor(lo + (i + 1) * step) - 1)) for i in range(bands)]


def query_set(engine, test_engine, lengths: tuple[int, int], n: int, seed: int = 42) -> list[tuple[str, list[float]]]:
    """Queries of small, medium and large length, from the data itself and from a test set on the data's scale."""
    draw, out = random.Random(seed), []
    for i, (lo, hi) in enumerate(length_bands(*lengths)):
        for j in range(math.ceil(n / 3)):
            size = draw.randint(lo, hi)
            out.append(("train", engine.random_window(size, seed=i * j)["data"]))
            if test_engine is not None:
                raw = test_engine.random_window(min(size, test_engine.max_len()), seed=i * j, normalised=False)["data"]
                out.append(("test", engine.normalise(raw)))
    return out


def sweep(engine, query, k: int, steps: int = 5) -> list[tuple[int, float]]:
    """(ke, error) of the index for ke growing from k by shares of all windows."""
    exact, total, out = engine.query_brute_force(query, k), engine.num_windows(), []
    for i in range(steps):
        ke = min(total, k + i * max(1, total // 100))
        out.append((ke, float(rank_error(engine.query(query, k, ke=ke), exact).first().error or 0.0)))
    return out


def timed_arms(engine, queries: list, k: int, arms: dict) -> list[dict]:
    """Seconds and error of each arm (name -> function of engine, query, k), against the exact scan."""
    rows = []
    for i, q in enumerate(queries):
        exact = engine.query_brute_force(q, k)
        for name, arm in arms.items():
            start = time.perf_counter()
            found = arm(engine, q, k)
            found.count()
            rows.append({"query": i, "arm": name, "seconds": time.perf_counter() - start, "error": float(rank_error(found, exact).first().error or 0.0)})
    return rows


def binned(results: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """Average of a value per bin of another."""
    return results.groupBy((F.floor(F.col(by) / width) * width).alias("bin")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset equality."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
