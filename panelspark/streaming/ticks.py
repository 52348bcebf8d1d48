"""Streams of ticks: bars per day behind a watermark, sessions, and running equity with drawdown per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame, key: str, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """(key, day, open, high, low, close, n): a day comes out once the watermark has passed it; later ticks are dropped."""
    at = F.struct(ts, value)
    g = ticks.withWatermark(ts, late).groupBy(key, F.window(ts, "1 day").alias("w"))
    out = g.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("day"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, first, last, n): runs of ticks with no pause of `gap` between them."""
    g = ticks.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def running_drawdown(returns: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, equity, peak, drawdown) after every batch of returns of a key; the state is three numbers a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, equity, peak = state.get if state.exists else (0, 1.0, 1.0)
        worst = 0.0
        for pdf in batches:
            for r in pdf[value].dropna():
                n, equity = n + 1, equity * (1 + float(r))
                peak = max(peak, equity)
                worst = equity / peak - 1
        state.update((n, equity, peak))
        yield pd.DataFrame({key: [k[0]], "n": [n], "equity": [equity], "peak": [peak], "drawdown": [worst]})

    out = f"{key} string, n long, equity double, peak double, drawdown double"
    return returns.groupBy(key).applyInPandasWithState(step, out, "n long, equity double, peak double", "update", "NoTimeout")
