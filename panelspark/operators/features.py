"""Cumulative and rolling features over an enriched panel (see panel.enrich): key algo_id, date, ret, rn, p, peak, dd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from .panel import by, last_rows, so_far

YEAR = 252.0


def _ratio(mean: Column, dev: Column) -> Column:
    return F.when(dev <= 1e-10, 0.0).otherwise(mean / F.when(dev > 1e-10, dev) * F.sqrt(F.lit(YEAR)))


def _gain(c: str = "ret") -> Column:
    return F.when(F.col(c) > 0, F.col(c)).otherwise(0.0)


def _loss(c: str = "ret") -> Column:
    return F.when(F.col(c) < 0, -F.col(c)).otherwise(0.0)


def _profit_factor(gain: Column, loss: Column) -> Column:
    return gain / F.when(loss > 1e-10, loss)


def cumulative(e: DataFrame, key: str = "algo_id") -> DataFrame:
    """Return since the first row, volatility (population), Sharpe, profit factor, greatest drawdown and Calmar to date."""
    w = by(key)
    c = so_far(w)
    first = F.first("p").over(c)
    out = e.withColumn("cum_return", F.col("p") / F.when(first != 0, first) - 1)
    out = out.withColumn("cum_vol", F.when(F.col("rn") >= 2, F.stddev_pop("ret").over(c) * F.sqrt(F.lit(YEAR))))
    out = out.withColumn("cum_sharpe", F.when(F.col("rn") >= 2, _ratio(F.avg("ret").over(c), F.stddev_pop("ret").over(c))))
    out = out.withColumn("cum_profit_factor", _profit_factor(F.sum(_gain()).over(c), F.sum(_loss()).over(c)))
    out = out.withColumn("max_drawdown", F.min("dd").over(c))
    growth = F.pow(F.greatest(F.col("cum_return") + 1, F.lit(0.0)), YEAR / F.col("rn")) - 1
    calmar = F.when(F.abs("max_drawdown") <= 1e-10, 0.0).otherwise(growth / F.when(F.col("max_drawdown") < -1e-10, F.abs("max_drawdown")))
    return out.withColumn("cum_calmar", F.when(F.col("rn") >= 21, calmar))


def rolling(e: DataFrame, n: int, key: str = "algo_id") -> DataFrame:
    """Return, volatility (population), Sharpe and profit factor of the last n rows; null until there are n."""
    w = by(key)
    r = last_rows(w, n)
    full = F.col("rn") >= n
    back = F.lag("p", n).over(w)
    out = e.withColumn("roll_return", F.col("p") / F.when(back != 0, back) - 1)
    out = out.withColumn("roll_vol", F.when(full, F.stddev_pop("ret").over(r) * F.sqrt(F.lit(YEAR))))
    out = out.withColumn("roll_sharpe", F.when(full, _ratio(F.avg("ret").over(r), F.stddev_pop("ret").over(r))))
    return out.withColumn("roll_profit_factor", F.when(full, _profit_factor(F.sum(_gain()).over(r), F.sum(_loss()).over(r))))


def rolling_max_drawdown(e: DataFrame, n: int, key: str = "algo_id") -> DataFrame:
    """Greatest drawdown within the last n rows, the peak starting anew with each window: a fold over at most n values."""
    values = F.collect_list("p").over(last_rows(by(key), n))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def step(acc: Column, x: Column) -> Column:
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), F.least(acc["d"], F.when(m > 0, x / F.when(m > 0, m) - 1).otherwise(0.0)).alias("d"))

    folded = F.aggregate("_v", start, step, lambda acc: acc["d"])
    return e.withColumn("_v", values).withColumn("roll_max_drawdown", F.when(F.col("rn") >= n, folded)).drop("_v")


def rolling_calmar(e: DataFrame, n: int, key: str = "algo_id") -> DataFrame:
    """Annualised return from the first to the last equity of the window over its greatest drawdown."""
    back = F.lag("p", n - 1).over(by(key))
    growth = F.pow(F.col("p") / F.when(back > 0, back), YEAR / n) - 1
    out = rolling_max_drawdown(e, n, key)
    return out.withColumn("roll_calmar", F.when(F.abs("roll_max_drawdown") <= 1e-10, 0.0).otherwise(growth / F.when(F.col("roll_max_drawdown") < -1e-10, F.abs("roll_max_drawdown"))))


def rolling_variants(e: DataFrame, n: int, key: str = "algo_id") -> DataFrame:
    """Rolling sum, mean, variance and Sharpe with the sample deviation, and the profit factor with 10 and 1 for no loss."""
    r = last_rows(by(key), n)
    full = F.col("rn") >= n
    out = e.withColumn("roll_sum", F.when(full, F.sum("ret").over(r))).withColumn("roll_mean", F.when(full, F.avg("ret").over(r)))
    out = out.withColumn("roll_var", F.when(full, F.var_samp("ret").over(r)))
    out = out.withColumn("sharpe_sample", F.when(full, _ratio(F.avg("ret").over(r), F.stddev_samp("ret").over(r))))
    gain, loss = F.sum(_gain()).over(r), F.sum(_loss()).over(r)
    return out.withColumn("profit_factor_10_1", F.when(full, F.when(loss > 1e-10, _profit_factor(gain, loss)).when(gain > 1e-10, 10.0).otherwise(1.0)))


def market_features(e: DataFrame, n: int, key: str = "algo_id") -> DataFrame:
    """Per date, over algorithms with n rows: mean rolling volatility (sample) and mean rolling sum of returns."""
    r = last_rows(by(key), n)
    full = F.col("rn") >= n
    out = e.withColumn("v", F.when(full, F.stddev_samp("ret").over(r) * F.sqrt(F.lit(YEAR)))).withColumn("s", F.when(full, F.sum("ret").over(r)))
    return out.groupBy("date").agg(F.avg("v").alias("mean_vol"), F.avg("s").alias("mean_sum"), F.count("v").alias("n"))


def technicals(bars: DataFrame, key: str = "file_id") -> DataFrame:
    """Moving averages, RSI by simple means, Bollinger bands, true range mean, distance to the year's high, of daily bars."""
    w = by(key)
    prev = F.lag("close").over(w)
    up = F.greatest(F.col("close") - prev, F.lit(0.0))
    down = F.greatest(prev - F.col("close"), F.lit(0.0))
    out = bars.withColumn("rn", F.row_number().over(w)).withColumn("up", F.when(prev.isNotNull(), up)).withColumn("down", F.when(prev.isNotNull(), down))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    out = out.withColumn("tr", tr).withColumn("_ret", F.col("close") / prev - 1)
    full = lambda n, c: F.when(F.col("rn") >= n, c)
    mean = lambda c, n: F.avg(c).over(last_rows(w, n))
    dev = F.stddev_samp("close").over(last_rows(w, 20))
    out = out.withColumn("sma_20", full(20, mean("close", 20))).withColumn("sma_50", full(50, mean("close", 50)))
    gain, loss = mean("up", 14), mean("down", 14)
    out = out.withColumn("rsi_14", full(15, F.when(loss > 0, 100 - 100 / (1 + gain / F.when(loss > 0, loss))).otherwise(100.0)))
    out = out.withColumn("bb_high", full(20, mean("close", 20) + 2 * dev)).withColumn("bb_low", full(20, mean("close", 20) - 2 * dev))
    out = out.withColumn("atr_14", full(14, mean("tr", 14))).withColumn("from_high", F.col("close") / F.max("close").over(last_rows(w, 252)) - 1)
    m = last_rows(w, 21)
    n = F.count("_ret").over(m)
    skew = F.skewness("_ret").over(m) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return out.withColumn("skew_21", full(22, skew)).drop("up", "down", "tr", "_ret")


def trend_momentum(m: DataFrame) -> DataFrame:
    """Of one series (date, ret): 21-row volatility (sample), 63-row mean momentum, 21-row change of volatility, trend."""
    s = m.withColumn("_all", F.lit(1))
    w = by("_all")
    s = s.withColumn("rn", F.row_number().over(w))
    s = s.withColumn("vol_21", F.when(F.col("rn") >= 21, F.stddev_samp("ret").over(last_rows(w, 21)) * F.sqrt(F.lit(YEAR))))
    s = s.withColumn("momentum_63", F.when(F.col("rn") >= 63, F.avg("ret").over(last_rows(w, 63)) * YEAR))
    s = s.withColumn("trend_21", F.when(F.col("rn") >= 21, F.sum("ret").over(last_rows(w, 21))))
    return s.withColumn("vol_change", F.col("vol_21") - F.lag("vol_21", 21).over(w)).drop("_all")


def expanding_quantiles(m: DataFrame, value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Of one series: exact quantiles, linearly interpolated, of all values to date."""
    w = so_far(Window.partitionBy(F.lit(1)).orderBy("date"))
    return m.withColumns({f"q{int(q * 100)}": F.expr(f"percentile({value}, {q})").over(w) for q in at})


def autocorrelation(e: DataFrame, lag: int, key: str = "algo_id") -> DataFrame:
    """(key, autocorr, n): correlation of a return with the one `lag` rows before."""
    x = e.withColumn("_l", F.lag("ret", lag).over(by(key))).filter("_l IS NOT NULL")
    return x.groupBy(key).agg(corr("ret", "_l").alias("autocorr"), F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, key: str | list[str], state: str, order: str = "date") -> DataFrame:
    """(key, state, first, last, length): runs of equal states, by the difference of two row numbers."""
    keys = [key] if isinstance(key, str) else key
    whole = F.row_number().over(by(keys, order))
    same = F.row_number().over(by([*keys, state], order))
    marked = df.withColumn("_g", whole - same)
    return marked.groupBy(*keys, state, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def streaks(e: DataFrame, key: str = "algo_id") -> DataFrame:
    """(key, best, worst): longest runs of gains and of losses; a zero ends both."""
    r = runs(e.withColumn("_s", F.signum("ret").cast("int")), key, "_s")
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_s") == s, F.col("length"))), F.lit(0).cast("long"))
    return r.groupBy(key).agg(longest(1).alias("best_streak"), longest(-1).alias("worst_streak"))


def first_deep_drawdown(e: DataFrame, depth: float = -0.05, key: str = "algo_id") -> DataFrame:
    """(key, at): position, as a share of all rows, of the first drawdown of at least that depth; 1 if there is none."""
    return e.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("dd") <= depth, F.col("rn") - 1)) / F.count(F.lit(1)), F.lit(1.0)).alias("first_deep_drawdown"))


def terciles(e: DataFrame, key: str = "algo_id") -> DataFrame:
    """(key, part, mean_ret, vol, total, n): by thirds of the rows, the last one taking the remainder."""
    size = F.greatest(F.floor(F.col("_n") / 3), F.lit(1))
    part = F.least(F.floor((F.col("rn") - 1) / size), F.lit(2)).cast("int")
    x = e.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("part", part)
    return x.groupBy(key, "part").agg(F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("vol"), (F.product(1 + F.col("ret")) - 1).alias("total"), F.count(F.lit(1)).alias("n"))


def leave_one_out_beta(panel: DataFrame, key: str = "algo_id") -> DataFrame:
    """(key, beta, corr, n): against the mean return of all other algorithms of the day."""
    total = panel.groupBy("date").agg(F.sum("ret").alias("_s"), F.count(F.lit(1)).alias("_n"))
    x = panel.join(total, "date").filter("_n > 1").withColumn("others", (F.col("_s") - F.col("ret")) / (F.col("_n") - 1))
    var = F.var_samp("others")
    return x.groupBy(key).agg((F.covar_samp("ret", "others") / F.when(var > 1e-15, var)).alias("beta"), corr("ret", "others").alias("corr"), F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with avg_rank (ties share the mean rank) and pct_rank (avg_rank over the number of rows), by group."""
    w = Window.partitionBy(group).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(group, value))
    x = df.withColumn("avg_rank", F.rank().over(w) + (ties - 1) / 2.0)
    return x.withColumn("pct_rank", F.col("avg_rank") / F.count(F.lit(1)).over(Window.partitionBy(group)))


def activity_gaps(dense: DataFrame, key: str = "algo_id") -> DataFrame:
    """dense (key, date, present) with days since the last and until the next active day; 0 on active days."""
    w = by(key)
    seen = F.last(F.when(F.col("present"), F.col("date")), ignorenulls=True).over(so_far(w))
    coming = F.last(F.when(F.col("present"), F.col("date")), ignorenulls=True).over(so_far(by(key, F.col("date").desc())))
    return dense.withColumn("since_last", F.datediff("date", seen)).withColumn("until_next", F.datediff(coming, "date"))


def alive(dense: DataFrame, days: int, key: str = "algo_id") -> DataFrame:
    """dense with alive: any activity in the `days` rows before, today excluded; true where there is no row before."""
    before = by(key).rowsBetween(-days, -1)
    return dense.withColumn("alive", F.coalesce(F.max(F.col("present").cast("int")).over(before) == 1, F.lit(True)))


def filled_and_interpolated(dense: DataFrame, value: str, key: str = "algo_id") -> DataFrame:
    """dense with the value carried forward, carried back, and interpolated linearly in time between known ones."""
    w = by(key)
    known = F.col(value).isNotNull()
    back, ahead = so_far(w), so_far(by(key, F.col("date").desc()))
    at = F.struct(F.col("date").alias("d"), F.col(value).alias("v"))
    x = dense.withColumn("_a", F.last(F.when(known, at), ignorenulls=True).over(back)).withColumn("_b", F.last(F.when(known, at), ignorenulls=True).over(ahead))
    gap = F.datediff(F.col("_b.d"), F.col("_a.d"))
    linear = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.datediff("date", F.col("_a.d")) / F.when(gap > 0, gap)
    return x.withColumn("ffill", F.col("_a.v")).withColumn("bfill", F.col("_b.v")).withColumn("linear", F.when(known, F.col(value)).otherwise(linear)).drop("_a", "_b")


def centred_mode(df: DataFrame, state: str, half: int = 2, key: str | None = None) -> DataFrame:
    """df with smoothed: the commonest state of the rows around, of equally common ones the first seen."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(1))).orderBy("date").rowsBetween(-half, half)
    seen = F.collect_list(state).over(w)
    x = df.withColumn("_seen", seen)
    count = lambda s: F.size(F.filter("_seen", lambda y: y == s))
    ranked = F.transform(F.array_distinct("_seen"), lambda s: F.struct(count(s).alias("n"), (-F.array_position("_seen", s)).alias("first"), s.alias("s")))
    return x.withColumn("smoothed", F.array_max(ranked)["s"]).drop("_seen")
