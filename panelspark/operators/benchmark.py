"""Weights, turnover, concentration, holdings, cash flows and index reconstruction from trades and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from ..sources.tables import with_single
from .panel import by, so_far


def shares(amounts: DataFrame, value: str = "total") -> DataFrame:
    """amounts (date, algo_id, value) with w, the share of the date's total; null where that is 0."""
    total = F.sum(value).over(Window.partitionBy("date"))
    return amounts.withColumn("w", F.col(value) / F.when(total != 0, total))


def turnover(weights: DataFrame) -> DataFrame:
    """(date, turnover): half the sum of absolute changes from the previous date of the calendar; 0 on the first.

    A missing row is a weight of 0. A change at a date is a row there, or a row at the date before: every row is put
    at its own date with its sign and at the next date with the opposite one, and the sums are taken.
    """
    days = weights.select("date").distinct()
    nxt = days.withColumn("next", F.lead("date").over(Window.orderBy("date")))  # the calendar, one row a day on record
    x = weights.join(nxt, "date")
    moves = x.select("algo_id", F.explode(F.array(F.struct(F.col("date").alias("date"), F.col("w").alias("dw")), F.struct(F.col("next").alias("date"), (-F.col("w")).alias("dw")))).alias("m"))
    change = moves.select("algo_id", "m.*").filter("date IS NOT NULL").groupBy("date", "algo_id").agg(F.sum("dw").alias("dw"))
    first = days.agg(F.min("date").alias("_first"))
    out = with_single(change.groupBy("date").agg((F.sum(F.abs("dw")) / 2).alias("turnover")), first)
    return out.select("date", F.when(F.col("date") == F.col("_first"), 0.0).otherwise(F.col("turnover")).alias("turnover"))


def concentration(weights: DataFrame, least: float = 0.001) -> DataFrame:
    """(date, hhi, effective_n, n_positions, top_5, max_weight)."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.col("w").desc(), "algo_id"))
    g = weights.withColumn("_r", rank).groupBy("date").agg(
        F.sum(F.col("w") * F.col("w")).alias("hhi"), F.count_if(F.col("w") > least).alias("n_positions"), F.sum(F.when(F.col("_r") <= 5, F.col("w"))).alias("top_5"), F.max("w").alias("max_weight"),
    )
    return g.withColumn("effective_n", 1 / F.when(F.col("hhi") > 0, F.col("hhi")))


def lagged_portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(date, ret): yesterday's weights times today's returns, over the calendar that both have; null if no term is known."""
    days = weights.select("date").distinct().join(returns.select("date").distinct(), "date")
    nxt = days.withColumn("next", F.lead("date").over(Window.orderBy("date")))
    held = weights.join(nxt, "date").select(F.col("next").alias("date"), "algo_id", "w").filter("date IS NOT NULL")
    terms = returns.join(held, ["date", "algo_id"]).groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    return days.select("date").join(terms, "date", "left")


def holdings(trades: DataFrame) -> DataFrame:
    """(algo_id, date, units): cumulative volume opened less closed, cut at 0 after the sum, on days with a change."""
    moves = F.array(F.struct(F.col("day_open").alias("date"), F.col("volume").alias("v")), F.when(F.col("date_close").isNotNull(), F.struct(F.col("day_close").alias("date"), (-F.col("volume")).alias("v"))))
    m = trades.filter("volume IS NOT NULL").select("algo_id", F.explode(F.array_compact(moves)).alias("m")).select("algo_id", "m.*")
    daily = m.groupBy("algo_id", "date").agg(F.sum("v").alias("v"))
    return daily.withColumn("units", F.greatest(F.round(F.sum("v").over(so_far(by("algo_id"))), 9), F.lit(0.0))).drop("v")


def cash_flows(fund: DataFrame, threshold: float = 100.0) -> DataFrame:
    """fund (date, equity, ret) with flow = equity - previous equity * (1 + ret), its kind, and cumulative in- and outflows."""
    w = Window.orderBy("date")  # one series, a row a day
    prev = F.lag("equity").over(w)
    x = fund.withColumn("flow", F.coalesce(F.col("equity") - prev * (1 + F.coalesce("ret", F.lit(0.0))), F.lit(0.0)))
    kind = F.when(F.col("flow") > threshold, "INFLOW").when(F.col("flow") < -threshold, "OUTFLOW").otherwise("NONE")
    c = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("kind", kind)
    return x.withColumn("cum_in", F.sum(F.when(F.col("kind") == "INFLOW", F.col("flow")).otherwise(0.0)).over(c)).withColumn("cum_out", F.sum(F.when(F.col("kind") == "OUTFLOW", F.col("flow")).otherwise(0.0)).over(c))


def dietz_daily(flows: DataFrame, clip: float = 0.5) -> DataFrame:
    """flows (date, equity, flow) with dietz: (EV - BV - C) / (BV + C / 2), clipped; null on the first date or for no base."""
    prev = F.lag("equity").over(Window.orderBy("date"))
    base = prev + F.col("flow") / 2
    r = (F.col("equity") - prev - F.col("flow")) / F.when(base != 0, base)
    return flows.withColumn("dietz", F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(clip)), F.lit(-clip))))


def dietz_monthly(flows: DataFrame, threshold: float = 100.0) -> DataFrame:
    """(month, ret): modified Dietz by month, flows of more than the threshold weighted by the part of the month left."""
    month = F.trunc("date", "MM")
    days = F.dayofmonth(F.last_day("date"))
    x = flows.withColumn("month", month).withColumn("c", F.when(F.abs("flow") > threshold, F.col("flow")).otherwise(0.0)).withColumn("cw", F.col("c") * (days - F.dayofmonth("date")) / days)
    m = x.groupBy("month").agg(F.max_by("equity", "date").alias("ev"), F.min_by("equity", "date").alias("first"), F.sum("c").alias("c"), F.sum("cw").alias("cw"))
    bv = F.coalesce(F.lag("ev").over(Window.orderBy("month")), F.col("first"))
    m = m.withColumn("bv", bv)
    base = F.col("bv") + F.col("cw")
    return m.select("month", ((F.col("ev") - F.col("bv") - F.col("c")) / F.when(base != 0, base)).alias("ret"))


def twr_subperiods(flows: DataFrame, share: float = 0.01) -> DataFrame:
    """(part, first, last, ret): sub-periods that a flow of more than `share` of the previous equity starts anew, with their compounded unit return."""
    w = Window.orderBy("date")
    prev = F.lag("equity").over(w)
    big = F.coalesce((F.abs("flow") / F.when(prev != 0, F.abs(prev))) > share, F.lit(False))
    x = flows.withColumn("part", F.sum(big.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("part").agg(F.min("date").alias("first"), F.max("date").alias("last"), (F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))


def weighted_index(holdings_: DataFrame, returns: DataFrame, weight: Column, base: float = 100.0) -> DataFrame:
    """(date, index, coverage): base * exp of the cumulated weighted log returns; holdings_ and returns meet on (date, algo_id)."""
    x = returns.join(holdings_, ["date", "algo_id"]).withColumn("_w", weight).filter("_w > 0 AND ret > -1")
    per = x.groupBy("date").agg((F.sum(F.col("_w") * F.ln(1 + F.col("ret"))) / F.sum("_w")).alias("lr"), F.count(F.lit(1)).alias("coverage"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("date", (F.lit(base) * F.exp(F.sum("lr").over(w))).alias("index"), "coverage")


def recovery(series: DataFrame, value: str, near: float = -0.001) -> DataFrame:
    """(trough, max_drawdown, recovered, days): the deepest drawdown of a series and the first date after it with less than `near`."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = series.withColumn("dd", F.col(value) / F.max(value).over(w) - 1)
    low = x.agg(F.min("dd").alias("max_drawdown"), F.min_by("date", F.struct("dd", "date")).alias("trough"))
    after = with_single(x, low).filter((F.col("date") > F.col("trough")) & (F.col("dd") > near)).agg(F.min("date").alias("recovered"))
    return with_single(low, after).select("trough", "max_drawdown", "recovered", F.datediff("recovered", "trough").alias("days"))


def reconstruction_statistics(series: DataFrame, year: float = 252.0) -> DataFrame:
    """One row on a reconstruction r held against the actual a (date, a, r: levels): both start at 100, compared by level and by log return.

    R squared is 1 minus the squared differences of log returns over those from the actual's mean; the monthly
    correlation is that of month-end levels, 0 up to three months. Rows in which either is missing do not count; without
    any, all but the counts and that 0 are null.
    """
    w = Window.orderBy("date")  # one series, a row a day
    x = series.filter("a IS NOT NULL AND r IS NOT NULL")
    x = with_single(x, x.agg(F.min_by("a", "date").alias("_a0"), F.min_by("r", "date").alias("_r0")))
    x = x.select("date", (F.col("a") / F.col("_a0") * 100).alias("a"), (F.col("r") / F.col("_r0") * 100).alias("r"))
    l = x.withColumn("la", F.ln(F.col("a") / F.lag("a").over(w))).withColumn("lr", F.ln(F.col("r") / F.lag("r").over(w)))  # noqa: E741
    l = with_single(l, l.agg(F.avg("la").alias("_m"))).withColumn("d", F.col("la") - F.col("lr"))  # noqa: E741
    total = F.sum((F.col("la") - F.col("_m")) * (F.col("la") - F.col("_m")))
    last = lambda c: F.max_by(c, "date")
    out = l.agg(
        F.count(F.lit(1)).alias("n_days"), corr("la", "lr").alias("correlation_daily"), F.when(total > 0, 1 - F.sum(F.col("d") * F.col("d")) / F.when(total > 0, total)).when(total == 0, 0.0).alias("r_squared"), (F.stddev_samp("d") * F.sqrt(F.lit(year))).alias("tracking_error_annual"),
        F.sqrt(F.avg((F.col("r") - F.col("a")) * (F.col("r") - F.col("a")))).alias("rmse_index"), F.max(F.abs(F.col("r") - F.col("a"))).alias("max_deviation"), ((last("r") - last("a")) / last("a") * 100).alias("final_diff_pct"),
    )
    months = x.groupBy(F.trunc("date", "MM").alias("m")).agg(last("a").alias("a"), last("r").alias("r"))
    return with_single(out, months.agg(F.when(F.count(F.lit(1)) > 3, corr("a", "r")).otherwise(0.0).alias("monthly_correlation")))
