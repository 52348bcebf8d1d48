"""Bars, returns, equity, drawdown and trimming of long panels (entity, date, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.tables import with_single


def by(key: str | list[str], order: str | Column | list[str] = "date") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*(order if isinstance(order, list) else [order]))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def daily_bars(ticks: DataFrame, key: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """(key, date, open, high, low, close, n): first, greatest, least and last of each day in UTC, ordered by time and tie."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    return ticks.groupBy(key, F.col(ts).cast("date").alias("date")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.count(F.lit(1)).alias("n"),
    )


def grid_resample(df: DataFrame, key: str, ts: str, value: str, width: str) -> DataFrame:
    """(key, bin, total, last, n): sums and last values on an epoch-aligned grid."""
    bin_ = F.window(ts, width)
    return df.groupBy(key, bin_.alias("w")).agg(F.sum(value).alias("total"), F.max_by(value, ts).alias("last"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("bin"), "total", "last", "n")


def simple_returns(df: DataFrame, key: str, close: str = "close") -> DataFrame:
    """df with ret and log_ret against the previous row; null on the first row or where the previous value is 0."""
    prev = F.lag(close).over(by(key))
    ratio = F.col(close) / F.when(prev != 0, prev)
    return df.withColumn("ret", ratio - 1).withColumn("log_ret", F.when(ratio > 0, F.ln(ratio)))


def enrich(panel: DataFrame, key: str = "algo_id", ret: str = "ret") -> DataFrame:
    """panel with rn, p (equity from 1), peak and dd, over one sort per entity."""
    w = by(key)
    out = panel.withColumn("rn", F.row_number().over(w)).withColumn("p", F.product(1 + F.col(ret)).over(so_far(w)))
    out = out.withColumn("peak", F.max("p").over(so_far(w)))
    return out.withColumn("dd", F.when(F.col("peak") > 0, F.col("p") / F.when(F.col("peak") > 0, F.col("peak")) - 1).otherwise(0.0))


def trim_dead_tail(panel: DataFrame, key: str, ret: str = "ret", min_share: float = 0.10, min_days: int = 5, still: float = 1e-12) -> DataFrame:
    """panel with n, alive, dead, was_trimmed and kept: whether a row stays once a long motionless tail is cut off.

    p: the last row (from 0) with a move. dead = n - p - 1; the tail goes, but for one row, if it has more than
    min_days rows and more than min_share of all. Fewer than five rows, or no move at all: nothing goes.
    """
    part = Window.partitionBy(key)
    rn = F.row_number().over(by(key))
    out = panel.withColumn("rn", rn).withColumn("n", F.count(F.lit(1)).over(part))
    out = out.withColumn("_last", F.max(F.when(F.abs(ret) > still, F.col("rn"))).over(part))
    dead = F.col("n") - F.col("_last")
    trimmed = (F.col("n") >= 5) & F.col("_last").isNotNull() & (dead > min_days) & (dead / F.col("n") > min_share)
    out = out.withColumn("was_trimmed", F.coalesce(trimmed, F.lit(False)))
    out = out.withColumn("dead", F.when(F.col("was_trimmed"), dead).otherwise(0)).withColumn("alive", F.when(F.col("_last").isNull() & (F.col("n") >= 5), 0).otherwise(F.col("n") - F.col("dead")))
    return out.withColumn("kept", ~F.col("was_trimmed") | (F.col("rn") <= F.col("_last") + 1)).drop("_last")


def equity_with_base(panel: DataFrame, key: str, base: float = 100.0) -> DataFrame:
    """(key, date, equity) from base, with a row of the base itself on the day before the first."""
    e = enrich(panel, key).select(key, "date", (F.col("p") * base).alias("equity"))
    first = panel.groupBy(key).agg(F.min("date").alias("date")).select(key, F.date_sub("date", 1).alias("date"), F.lit(base).alias("equity"))
    return first.unionByName(e)


def densify(panel: DataFrame, key: str, value: str, fill: Column | None = None) -> DataFrame:
    """(key, date, value, present): a row for every day of the common calendar between an entity's first and last.

    The calendar is that of all entities' dates, so its size is bounded by the days on record.
    """
    days = panel.select("date").distinct()
    calendar = days.agg(F.array_sort(F.collect_set("date")).alias("days"))  # one row, one date per day on record
    span = panel.groupBy(key).agg(F.min("date").alias("a"), F.max("date").alias("z"))
    grid = with_single(span, calendar).select(key, F.explode(F.filter("days", lambda x: (x >= F.col("a")) & (x <= F.col("z")))).alias("date"))
    out = grid.join(panel.select(key, "date", value, F.lit(True).alias("present")), [key, "date"], "left")
    filled = F.coalesce(F.col(value), fill) if fill is not None else F.col(value)
    return out.select(key, "date", filled.alias(value), F.coalesce("present", F.lit(False)).alias("present"))
