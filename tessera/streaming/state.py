"""Stateful streams: a router's moving averages, updated with each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALPHA, CONFIDENCE, LATENCY = 0.1, 0.5, 1000.0


def router_state(feedback: DataFrame) -> DataFrame:
    """Per tier of (tier, seq, confidence, latency): queries so far and moving averages, in order of seq within a batch."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, c, t = state.get if state.exists else (0, CONFIDENCE, LATENCY)
        rows = pd.concat(list(frames)).sort_values("seq")
        for x, y in zip(rows["confidence"], rows["latency"], strict=True):
            x = x / 100 if x > 1 else x
            n, c, t = n + 1, ALPHA * x + (1 - ALPHA) * c, ALPHA * y + (1 - ALPHA) * t
        state.update((n, c, t))
        yield pd.DataFrame({"tier": [key[0]], "queries": [n], "confidence": [c], "latency": [t]})

    return feedback.groupBy("tier").applyInPandasWithState(update, "tier string, queries long, confidence double, latency double", "n long, c double, t double", "update", GroupStateTimeout.NoTimeout)
