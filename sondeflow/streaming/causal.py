"""Causal features and a recursive tracker on unbounded sequences, and time windows over events.

The batch features that look only backwards (trailing means, steps) are functions of a short state, so each key's state here is its last few
values; a tracker's state is its place and rate. State is bounded for each key and expires with event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and means over fixed windows of event time; rows later than `late` are dropped by the watermark (in streams)."""
    out = events.withWatermark(at, late) if events.isStreaming else events
    return out.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, at: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Runs of events of each key with no pause of `gap` or more."""
    out = events.withWatermark(at, late) if events.isStreaming else events
    return out.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def trailing_means(events: DataFrame, key: str, order: str, value: str, width: int, idle: str = "1 hour") -> DataFrame:
    """key, order, value and the mean over the last `width` rows of the key, nulls left out, as events come. Within a batch events go in the order of `order`;
    state is `width` values, dropped after `idle` of processing time without events."""
    kinds = dict(events.dtypes)
    minutes = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(who, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        means = []
        for v in pdf[value]:  # rows without a value take a place in the window, as in the batch form
            last = (last + [float(v) if pd.notna(v) else float("nan")])[-width:]
            there = [x for x in last if x == x]
            means.append(sum(there) / len(there) if there else None)
        state.update((last,))
        state.setTimeoutDuration(minutes)
        yield pd.DataFrame({key: pdf[key], order: pdf[order], value: pdf[value], "mean": means})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, mean double"
    return events.groupBy(key).applyInPandasWithState(run, schema, "last array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def places(events: DataFrame, curve: tuple[list[float], list[float]], key: str, order: str, value: str, start: float, reach: float = 25.0, stay: float = 0.15, idle: str = "1 hour") -> DataFrame:
    """key, order, value and the place on a curve (knots x and y, one curve of all keys) that a tracker reaches as events come: the knot within reach of the last
    place with the least residual and distance, the first of equals; an event without a value stays. State is one place, dropped after `idle`."""
    import numpy as np

    kinds, x, y = dict(events.dtypes), np.asarray(curve[0], float), np.asarray(curve[1], float)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(who, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = state.get[0] if state.exists else float(start)
        pdf, found = pd.concat(list(frames)).sort_values(order, kind="stable"), []
        for v in pdf[value]:
            if pd.notna(v):
                cost = np.where(np.abs(x - at) <= reach, np.abs(y - v) + stay * np.abs(x - at), np.inf)
                at = float(x[cost.argmin()]) if np.isfinite(cost.min(initial=np.inf)) else at
            found.append(at)
        state.update((at,))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame({key: pdf[key], order: pdf[order], value: pdf[value], "place": found})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, place double"
    return events.groupBy(key).applyInPandasWithState(run, schema, "place double", "append", GroupStateTimeout.ProcessingTimeTimeout)
