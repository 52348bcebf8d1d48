"""Performance metrics per entity, each in the variant its name states.

All work on an enriched panel (panel.enrich) and end in one aggregation per entity; groups combine on the map side
except for exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from .panel import by, so_far

YEAR = 252.0


def div(a: Column, b: Column, least: float = 1e-10, other: Column | float | None = 0.0) -> Column:
    """a / b, or `other` where b is null or at most `least` in size."""
    ok = F.abs(b) > least
    return F.when(ok, a / F.when(ok, b)).otherwise(F.lit(other) if not isinstance(other, Column) else other)


def annual_return() -> Column:
    """Geometric, n / 252 years; -1 from a total loss on."""
    g = F.product(1 + F.col("ret"))
    return F.when(g > 0, F.pow(F.when(g > 0, g), YEAR / F.count(F.lit(1))) - 1).otherwise(-1.0)


def annual_vol() -> Column:
    return F.stddev_samp("ret") * F.sqrt(F.lit(YEAR))


def sharpe() -> Column:
    """Mean over sample deviation, annualised; 0 if that is next to none."""
    return div(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(YEAR))


def sortino() -> Column:
    """Mean over the root mean square of the losses; 0 with fewer than two losses."""
    loss = F.when(F.col("ret") < 0, F.col("ret"))
    return F.when(F.count(loss) >= 2, div(F.avg("ret"), F.sqrt(F.avg(loss * loss))) * F.sqrt(F.lit(YEAR))).otherwise(0.0)


def quantile(p: float) -> Column:
    return F.expr(f"percentile(ret, {p})")


def corrected_skewness(c: str = "ret") -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def corrected_kurtosis(c: str = "ret") -> Column:
    n = F.count(c)
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def summary(e: DataFrame, key: str = "algo_id") -> DataFrame:
    """(key, n, start, end, mean, std, min, max, ann_return, ann_vol, sharpe, sortino, max_drawdown, calmar, win_rate, skew, kurt)."""
    g = e.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("start"), F.max("date").alias("end"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"),
        F.min("ret").alias("min"), F.max("ret").alias("max"), annual_return().alias("ann_return"), annual_vol().alias("ann_vol"), sharpe().alias("sharpe"), sortino().alias("sortino"),
        F.min("dd").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"), corrected_skewness().alias("skew"), corrected_kurtosis().alias("kurt"),
    )
    return g.withColumn("calmar", div(F.col("ann_return"), F.abs("max_drawdown")))


def tails(panel: DataFrame, key: str = "algo_id", alpha: float = 0.05) -> DataFrame:
    """(key, var, cvar, tail_ratio, omega, common_sense): VaR by linear interpolation, CVaR the mean at or below it; 10 or 1 where there are no losses."""
    q = panel.groupBy(key).agg(quantile(alpha).alias("var"), quantile(1 - alpha).alias("_hi"))
    gain, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") < 0, -F.col("ret"))
    g = panel.join(q, key).groupBy(key).agg(F.first("var").alias("var"), F.first("_hi").alias("_hi"), F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("_g"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("_l"))
    g = g.withColumn("tail_ratio", div(F.abs("_hi"), F.abs("var")))
    omega = F.when(F.col("_l") > 1e-10, F.col("_g") / F.when(F.col("_l") > 1e-10, F.col("_l"))).when(F.col("_g") > 1e-10, 10.0).otherwise(1.0)
    g = g.withColumn("omega", omega)
    return g.withColumn("common_sense", F.col("tail_ratio") * F.col("omega")).drop("_hi", "_g", "_l")


def tails_by_index(panel: DataFrame, key: str = "algo_id", alpha: float = 0.05) -> DataFrame:
    """(key, var_index, cvar_index): the value at position int(alpha n) of the sorted ones, and the mean of those before it (one at least)."""
    w = Window.partitionBy(key).orderBy("ret")
    x = panel.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    at = F.floor(F.lit(alpha) * F.col("_n"))
    return x.groupBy(key).agg(F.max(F.when(F.col("_i") == at, F.col("ret"))).alias("var_index"), F.avg(F.when(F.col("_i") < F.greatest(at, F.lit(1)), F.col("ret"))).alias("cvar_index"))


def drawdown_from_one(panel: DataFrame, key: str = "algo_id") -> DataFrame:
    """(key, max_drawdown_from_one, longest_below): the peak starts at 1, so a loss on the first day counts; longest run of rows below the peak."""
    c = so_far(by(key))
    x = panel.withColumn("p", F.product(1 + F.col("ret")).over(c)).withColumn("peak", F.greatest(F.max("p").over(c), F.lit(1.0)))
    x = x.withColumn("below", F.col("p") < F.col("peak"))
    x = x.withColumn("_g", F.sum((~F.col("below")).cast("int")).over(c))
    runs = x.groupBy(key, "_g").agg(F.sum(F.col("below").cast("int")).alias("len"), F.min(F.col("p") / F.col("peak") - 1).alias("dd"))
    return runs.groupBy(key).agg(F.min("dd").alias("max_drawdown_from_one"), F.max("len").alias("longest_below"))


def against(panel: DataFrame, bench: DataFrame, key: str = "algo_id") -> DataFrame:
    """(key, beta, alpha, corr, tracking_error, information_ratio, excess, n) against bench (date, b), on the days of both."""
    j = panel.join(bench, "date").withColumn("x", F.col("ret") - F.col("b"))
    grow = lambda c: F.product(1 + F.col(c))
    annual = lambda c: F.when(grow(c) > 0, F.pow(F.when(grow(c) > 0, grow(c)), YEAR / F.count(F.lit(1))) - 1).otherwise(-1.0)
    g = j.groupBy(key).agg(F.covar_samp("ret", "b").alias("_c"), F.var_samp("b").alias("_v"), corr("ret", "b").alias("corr"), (F.stddev_samp("x") * F.sqrt(F.lit(YEAR))).alias("tracking_error"), annual("ret").alias("_r"), annual("b").alias("_b"), annual("x").alias("excess"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("beta", div(F.col("_c"), F.col("_v"), 1e-15))
    g = g.withColumn("alpha", F.col("_r") - F.col("beta") * F.col("_b")).withColumn("information_ratio", div(F.col("excess"), F.col("tracking_error")))
    return g.drop("_c", "_v", "_r", "_b")


def compounded(panel: DataFrame, unit: str, key: str | None = "algo_id") -> DataFrame:
    """(key, period, ret, n): returns compounded by calendar unit (a trunc format)."""
    keys = [key] if key else []
    return panel.groupBy(*keys, F.trunc("date", unit).alias("period")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.count(F.lit(1)).alias("n"))


def by_label(panel: DataFrame, labels: DataFrame, label: str, key: str = "algo_id", more_than: int = 10) -> DataFrame:
    """(key, label, n, ann_return, ann_vol, sharpe) on the days of each label, where there are more than `more_than`."""
    j = panel.join(labels, "date")
    return j.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"), annual_return().alias("ann_return"), annual_vol().alias("ann_vol"), sharpe().alias("sharpe")).filter(F.col("n") > more_than)
