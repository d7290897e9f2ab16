"""Matching a stream of samples: the last samples of each series are kept as state, and
every new window of the query's length is compared with the query as it completes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from echoform.functions.batches import dtw_many, normalise
from echoform.functions.kernels import check_metric

OUT = "series_id string, start long, end long, dist double"


def match_stream(samples: DataFrame, query: list[float], metric: str, within: float) -> DataFrame:
    """samples: a streaming DataFrame (series_id, pos, value), pos ascending per series ->
    windows (series_id, start, end, dist) whose warped distance is at most ``within``.
    State per series is the last len(query) - 1 samples."""
    check_metric(metric)
    q, m = np.asarray(query, float), len(query)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pos, val = (list(x) for x in state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("pos")
        at, x = np.array([*pos, *new.pos], np.int64), np.array([*val, *new.value], float)
        if len(x) >= m:
            dist = normalise(dtw_many(np.lib.stride_tricks.sliding_window_view(x, m), q), m, m, metric)
            hit = np.flatnonzero(dist <= within)
            yield pd.DataFrame({"series_id": key[0], "start": at[hit], "end": at[hit + m - 1], "dist": dist[hit]})
        keep = max(m - 1, 0)
        state.update((at[len(at) - min(keep, len(at)):].tolist(), x[len(x) - min(keep, len(x)):].tolist()))

    return samples.groupBy("series_id").applyInPandasWithState(run, OUT, "pos array<long>, val array<double>", "append", "NoTimeout")
