"""Regime labels of one series and statistics of label sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import expanding_quantiles, runs, trend_momentum
from .panel import last_rows


def inputs(m: DataFrame) -> DataFrame:
    """Of one series (date, ret): trend (63 rows), volatility (21, sample), momentum (21 less 63), change of volatility (21)."""
    w = Window.orderBy("date")  # one series
    x = trend_momentum(m).withColumnRenamed("momentum_63", "trend").withColumnRenamed("vol_21", "vol").drop("trend_21")
    short = F.when(F.col("rn") >= 21, F.avg("ret").over(last_rows(w, 21)) * 252)
    return x.withColumn("momentum", short - F.col("trend"))


def heuristic(m: DataFrame) -> DataFrame:
    """(date, regime): by positive trend and volatility above its median to date; a condition without a value is false."""
    x = expanding_quantiles(inputs(m), "vol", (0.5,))
    up, high = F.coalesce(F.col("trend") > 0, F.lit(False)), F.coalesce(F.col("vol") > F.col("q50"), F.lit(False))
    label = F.when(up & ~high, "expansion").when(up & high, "slowdown").when(~up & ~high, "recovery").otherwise("recession")
    return x.select("date", label.alias("regime"))


def _ramp(x: Column, lo: Column, hi: Column) -> Column:
    """0 up to lo, 1 from hi on, linear between."""
    return F.when(x >= hi, 1.0).when(x <= lo, 0.0).otherwise((x - lo) / F.when(hi > lo, hi - lo))


def fuzzy(m: DataFrame) -> DataFrame:
    """(date, regime): greatest of four scores from ramps between the quartiles to date; of equal ones the first in the order of the phases.

    Ramps stand for high values, their complements for low ones. Warm-up rows without trend or volatility: unknown.
    """
    x = inputs(m)
    for c in ("trend", "vol", "momentum"):
        x = expanding_quantiles(x, c, (0.25, 0.75)).withColumnRenamed("q25", f"{c}_lo").withColumnRenamed("q75", f"{c}_hi")
    high = {c: _ramp(F.coalesce(c, F.lit(0.0)), F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in ("trend", "vol", "momentum")}
    low = {c: F.when(F.col(f"{c}_hi") == F.col(f"{c}_lo"), (F.coalesce(c, F.lit(0.0)) <= F.col(f"{c}_lo")).cast("double")).otherwise(1 - h) for c, h in high.items()}
    change = F.coalesce("vol_change", F.lit(0.0))
    widens = F.when(change > 0.001, 1.0).when(change > -0.001, 0.5).otherwise(0.0)
    calms = F.when(change < -0.001, 1.0).when(change < 0.001, 0.5).otherwise(0.0)
    rules = {
        "expansion": F.least(high["trend"], low["vol"], F.greatest(high["momentum"], F.lit(0.5))),
        "slowdown": F.greatest(F.least(high["trend"], F.greatest(high["vol"], widens * 0.7), low["momentum"]), F.least(high["trend"] * 0.8, high["vol"], widens)),
        "recession": F.least(low["trend"], high["vol"]),
        "recovery": F.greatest(F.least(F.greatest(low["trend"] * 0.5, F.lit(0.3)), low["vol"], high["momentum"]), F.least(low["trend"], calms, high["momentum"])),
    }
    names = list(rules)
    best = F.array_max(F.array(*(F.struct(F.round(rules[n], 9).alias("score"), F.lit(-i).alias("first"), F.lit(n).alias("name")) for i, n in enumerate(names))))
    known = F.col("trend").isNotNull() & F.col("vol").isNotNull()
    return x.select("date", F.when(known, best["name"]).otherwise("unknown").alias("regime"))


def transitions(labels: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """(from, to, n, p): counts of one label following another, and their share of all that follow the first."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(1))).orderBy("date")
    x = labels.withColumn("_next", F.lead(label).over(w)).filter("_next IS NOT NULL")
    c = x.groupBy(F.col(label).alias("from"), F.col("_next").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def durations(labels: DataFrame, label: str) -> DataFrame:
    """(label, n_runs, mean_length, longest): run lengths by label."""
    r = runs(labels.withColumn("_all", F.lit(1)), "_all", label)
    return r.groupBy(label).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("length").alias("mean_length"), F.max("length").alias("longest"))


def periods(labels: DataFrame, label: str, least_days: int) -> DataFrame:
    """(period, label, first, last, days): runs that span at least that many calendar days, numbered in order."""
    r = runs(labels.withColumn("_all", F.lit(1)), "_all", label).withColumn("days", F.datediff("last", "first") + 1).filter(F.col("days") >= least_days)
    return r.select(F.row_number().over(Window.orderBy("first")).alias("period"), label, "first", "last", "days")


def stability(labels: DataFrame, label: str, key: str = "algo_id", order: str = "week_end", ignore: tuple[str, ...] = ("inactive",)) -> DataFrame:
    """(key, n, changes, stability, mode, distinct): changes between successive labels, 1 - changes / (n - 1), smallest of the commonest labels."""
    x = labels.filter(~F.col(label).isin(*ignore) & F.col(label).isNotNull())
    prev = F.lag(label).over(Window.partitionBy(key).orderBy(order))
    x = x.withColumn("_c", (prev.isNotNull() & (prev != F.col(label))).cast("int"))
    g = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("changes"), F.expr(f"mode({label}, true)").alias("mode"), F.countDistinct(label).alias("distinct"))
    return g.withColumn("stability", F.when(F.col("n") >= 2, 1 - F.col("changes") / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(1.0))
