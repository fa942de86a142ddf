"""A token bucket for each key: capacity n, refilled by n / 60 a second. In batches and as a stream, with the same fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key long, event_id long, at double, allowed boolean"


def fold(times: np.ndarray, capacity: float, tokens: float | None = None, last: float | None = None) -> tuple[np.ndarray, float, float]:
    """Which of the ordered events are allowed, and the state after them."""
    out = np.zeros(len(times), dtype=bool)
    tokens = capacity if tokens is None else tokens
    for i, t in enumerate(times):
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, t - last) * capacity / 60.0)
        last = t
        if tokens >= 1.0:
            tokens -= 1.0
            out[i] = True
    return out, tokens, last


def limit(events: DataFrame, per_minute: int = 60) -> DataFrame:
    """Events (key, event_id, at in seconds) with whether each is allowed, in the order of at, then event_id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"])
        pdf["allowed"] = fold(pdf["at"].to_numpy(), float(per_minute))[0]
        return pdf

    return events.select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("double").alias("at")).groupBy("key").applyInPandas(run, SCHEMA)


def limit_stream(events: DataFrame, per_minute: int = 60) -> DataFrame:
    """The same over a stream: the bucket of each key is kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["at", "event_id"])
        tokens, last = state.get if state.exists else (None, None)
        pdf["allowed"], tokens, last = fold(pdf["at"].to_numpy(), float(per_minute), tokens, last)
        state.update((float(tokens), float(last)))
        yield pdf[["key", "event_id", "at", "allowed"]]

    e = events.select(F.col("key").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("double").alias("at"))
    return e.groupBy("key").applyInPandasWithState(run, SCHEMA, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
