"""Set-based backtests of weight schedules, walk-forward folds, and audits of allocations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_join


def run(weights: DataFrame, returns: DataFrame, same_day: bool = False) -> DataFrame:
    """(date, ret, n): each day's returns weighted by the schedule in force.

    weights (date, algo_id, w) hold from the day after their date (same_day: from the date itself, which looks ahead)
    until the next date of the schedule. A missing return counts 0. Days before the schedule have no row.
    """
    schedule = weights.select("date").distinct().withColumn("since", F.col("date"))
    days = asof_join(returns.select("date").distinct().withColumn("_k", F.lit(1)), schedule.withColumn("_k", F.lit(1)), ["_k"], "date", "date", ["since"], strict=not same_day).select("date", "since").filter("since IS NOT NULL")
    held = weights.select(F.col("date").alias("since"), "algo_id", "w")
    dated = returns.join(F.broadcast(days), "date")  # one row per day on record
    terms = dated.join(held, ["since", "algo_id"]).groupBy("date").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"), F.count(F.lit(1)).alias("n"))
    return days.select("date").join(terms, "date", "left").select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def folds(days: DataFrame, train: int, test: int, step: int, expanding: bool = False) -> DataFrame:
    """(fold_id, train_start, train_end, test_start, test_end) over the ordered days; as many as fit.

    The calendar has one row per day on record; the folds are read off it by position.
    """
    cal = days.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("d"))
    last = F.size("d") - train - test
    k = cal.filter(last >= 0).select("d", F.explode(F.sequence(F.lit(0), F.floor(last / step).cast("int"))).alias("fold_id"))
    at = lambda i: F.element_at("d", (i + 1).cast("int"))
    s = F.col("fold_id") * step
    return k.select("fold_id", at(F.lit(0) if expanding else s).alias("train_start"), at(s + train - 1).alias("train_end"), at(s + train).alias("test_start"), at(s + train + test - 1).alias("test_end"))


def allocation_periods(weights: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(algo_id, period_start, period_end, w): allocations over time, unchanged successive ones compressed into one.

    A period ends the day before the schedule's next date at which the weight changes; the last one is open.
    """
    w = Window.partitionBy("algo_id").orderBy("date")
    days = weights.select("date").distinct().withColumn("_next", F.lead("date").over(Window.orderBy("date")))
    x = weights.join(days, "date").withColumn("_pw", F.lag("w").over(w)).withColumn("_pn", F.lag("_next").over(w))
    changed = F.coalesce((F.abs(F.col("w") - F.col("_pw")) > tolerance) | (F.col("_pn") != F.col("date")), F.lit(True))
    x = x.withColumn("_g", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("algo_id", "_g").agg(F.min("date").alias("period_start"), F.max_by("_next", "date").alias("_n"), F.min_by("w", "date").alias("w"))
    return g.select("algo_id", "period_start", F.date_sub("_n", 1).alias("period_end"), "w")


def periods_of(schedule: DataFrame) -> DataFrame:
    """(period_start, period_end) of a schedule's dates; the last one open."""
    return schedule.select(F.col("date").alias("period_start"), F.date_sub(F.lead("date").over(Window.orderBy("date")), 1).alias("period_end"))


def allocate(panel: DataFrame, schedule: DataFrame, rows: int, optimize: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(date, algo_id, w): an optimizer's weights at each date of the schedule from the last `rows` returns up to that date.

    Dates are independent and spread over the cluster. A date's history is a dense matrix of `rows` dates and the
    algorithms that have a return on each of them.
    """
    cal = panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))  # one row a day on record
    at = cal.join(schedule, "date", "left_semi").select(F.col("date").alias("at"), F.explode(F.sequence(F.col("i") - rows + 1, F.col("i"))).alias("i")).join(cal, "i")
    hist = panel.join(at.select("date", "at"), "date").select("at", "date", "algo_id", "ret")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="date", columns="algo_id", values="ret", aggfunc="first")
        m = m.dropna(axis=1)
        if len(m) < rows or not m.shape[1]:
            return pd.DataFrame(columns=["date", "algo_id", "w"])
        return pd.DataFrame({"date": key[0], "algo_id": m.columns, "w": optimize(m.to_numpy(float))})

    return hist.groupBy("at").applyInPandas(fit, "date date, algo_id string, w double")
