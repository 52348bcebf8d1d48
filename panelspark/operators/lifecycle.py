"""What an algorithm did over its life: activity, performance, decay with age, behaviour against the others; trade features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from ..sources.tables import with_single
from .features import YEAR
from .panel import by, last_rows, so_far


def _root() -> Column:
    return F.sqrt(F.lit(YEAR))


def _skewness(c: str) -> Column:
    """Bias-corrected, from the population one; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurtosis(c: str) -> Column:
    """Bias-corrected excess; null below four values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def activity(panel: DataFrame, calendar: DataFrame, key: str = "algo_id") -> DataFrame:
    """(key, start_idx, end_idx, duration_ratio, active_ratio, n_gaps, gap_ratio, n_active_days): by position in the calendar.

    calendar: one row a date. Positions and the duration are shares of the calendar's length; gaps are runs of dates
    without a row between the first and the last one.
    """
    placed = calendar.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    x = panel.select(key, "date").distinct().join(placed, "date").withColumn("_step", F.col("_i") - F.lag("_i").over(by(key, "_i")))
    total = calendar.select(F.count_distinct("date").alias("_n"))
    g = x.groupBy(key).agg(
        F.min("_i").alias("a"), F.max("_i").alias("z"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_step") > 1).alias("n_gaps"), F.coalesce(F.sum(F.when(F.col("_step") > 1, F.col("_step") - 1)), F.lit(0)).alias("missing")
    )
    g = with_single(g, total)
    length = F.col("z") - F.col("a") + 1
    n = F.col("_n")
    return g.select(key, (F.col("a") / n).alias("start_idx"), (F.col("z") / n).alias("end_idx"), (length / n).alias("duration_ratio"), (F.col("n") / length).alias("active_ratio"), "n_gaps", (F.col("missing") / length).alias("gap_ratio"), F.col("n").alias("n_active_days"))


def performance(e: DataFrame, key: str = "algo_id") -> DataFrame:
    """Of an enriched panel (panel.enrich), per key: arithmetic annual return, volatility, Sortino by the deviation of losses, ulcer index, value at risk, slope and fit of equity.

    var_95 interpolates linearly; the slope is that of equity on the row number, times 252, 0 up to ten rows; without
    losses the profit factor is 10 with gains and 1 without, 10 at most.
    """
    loss, gain = F.when(F.col("ret") < 0, F.col("ret")), F.when(F.col("ret") > 0, F.col("ret"))
    q = e.withColumn("_q", F.expr("percentile(ret, 0.05)").over(Window.partitionBy(key)))
    g = q.groupBy(key).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.stddev_samp(loss).alias("ds"), F.count(loss).alias("losses"), (F.product(1 + F.col("ret")) - 1).alias("total_return"),
        F.min("dd").alias("max_dd"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"), F.max("_q").alias("var_95"), F.avg(F.when(F.col("ret") <= F.col("_q"), F.col("ret"))).alias("cvar_95"), _skewness("ret").alias("skewness"),
        _kurtosis("ret").alias("kurtosis"), F.avg((F.col("ret") > 0).cast("int")).alias("hit_ratio"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("gains"), F.coalesce(-F.sum(loss), F.lit(0.0)).alias("lost"),
        F.regr_slope("p", (F.col("rn") - 1).cast("double")).alias("slope"), F.regr_r2("p", (F.col("rn") - 1).cast("double")).alias("r2"),
    )
    year, vol = F.col("m") * YEAR, F.col("s") * _root()
    down = F.when(F.col("losses") > 0, F.col("ds") * _root()).otherwise(vol)
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    factor = F.when(F.col("lost") > 0, F.least(F.col("gains") / F.when(F.col("lost") > 0, F.col("lost")), F.lit(10.0))).when(F.col("gains") > 0, 10.0).otherwise(1.0)
    long = F.col("n") > 10
    return g.select(
        key, "total_return", year.alias("ann_return"), vol.alias("ann_vol"), ratio(year, vol).alias("sharpe"), ratio(year, down).alias("sortino"), "max_dd", "ulcer_index", "var_95", "cvar_95", "skewness", "kurtosis", "hit_ratio",
        factor.alias("profit_factor"), F.when(long, F.col("slope") * YEAR).otherwise(0.0).alias("equity_slope"), F.when(long, F.col("r2")).otherwise(0.0).alias("equity_r2"),
    )


def transition(e: DataFrame, key: str = "algo_id") -> DataFrame:
    """Per key: returns, volatility and Sharpe by thirds of its rows and their change, stability of rolling values, early performance.

    Thirds from 30 rows on, the last one taking the remainder; below, the whole counts as each third and the rest is
    0. Stability is 1 / (sample deviation of the 21-row mean or Sharpe + 0.01), from 63 rows on.
    """
    x = e.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    size, at, r = F.floor(F.col("_n") / 3), F.col("rn") - 1, F.col("ret")
    third = lambda i: F.when((F.col("_n") < 30) | ((at >= size * i) & ((at < size * (i + 1)) if i < 2 else F.lit(True))), r)
    early = F.least(F.lit(21), size)
    w = last_rows(by(key), 21)
    full = F.col("rn") >= 21
    x = x.withColumn("_m", F.when(full, F.avg("ret").over(w) * YEAR)).withColumn("_v", F.when(full, F.stddev_samp("ret").over(w) * _root()))
    x = x.withColumn("_s", F.when(F.col("_v") > 0, F.col("_m") / F.when(F.col("_v") > 0, F.col("_v"))))
    young = F.when(at < early, r)
    g = x.groupBy(key).agg(
        F.max("_n").alias("n"), *(F.avg(third(i)).alias(f"m{i}") for i in range(3)), *(F.stddev_samp(third(i)).alias(f"s{i}") for i in (0, 2)), F.stddev_samp("_s").alias("ss"), F.stddev_samp("_m").alias("sm"),
        F.avg(young).alias("me"), F.stddev_samp(young).alias("se"), F.max(early).alias("early"),
    )
    split = F.col("n") >= 30
    year = {i: F.col(f"m{i}") * YEAR for i in range(3)}
    vol = {i: F.col(f"s{i}") * _root() for i in (0, 2)}
    sharpe = {i: F.when(split & (vol[i] > 0), year[i] / F.when(vol[i] > 0, vol[i])).otherwise(0.0) for i in (0, 2)}
    change = lambda a, b: F.when(split, b - a).otherwise(0.0)
    steady = lambda c: F.when(F.col("n") >= 63, 1 / (F.col(c) + 0.01)).otherwise(0.0)
    has_early = F.col("early") > 5
    return g.select(
        key, year[0].alias("return_first_third"), year[1].alias("return_middle_third"), year[2].alias("return_last_third"), vol[0].alias("vol_first_third"), vol[2].alias("vol_last_third"),
        sharpe[0].alias("sharpe_first_third"), sharpe[2].alias("sharpe_last_third"), change(year[0], year[2]).alias("return_decay"), change(sharpe[0], sharpe[2]).alias("sharpe_decay"), change(vol[0], vol[2]).alias("vol_change"),
        steady("ss").alias("sharpe_stability"), steady("sm").alias("return_stability"), F.when(has_early, F.col("me") * YEAR).otherwise(0.0).alias("early_return"),
        F.when(has_early & (F.col("se") > 0), F.col("me") * YEAR / F.when(F.col("se") > 0, F.col("se") * _root())).otherwise(0.0).alias("early_sharpe"),
    )


def against(e: DataFrame, bench: DataFrame, key: str = "algo_id", least: int = 20) -> DataFrame:
    """(key, corr_benchmark, beta, alpha, trend_score, tracking_error, info_ratio) on the dates both have; 0, 1, 0, 0, 0, 0 with fewer than `least`.

    bench: date, ret. trend_score: correlation with the benchmark's return of the common date before (0 for the first).
    """
    x = e.select(key, "date", "ret").join(bench.select("date", F.col("ret").alias("b")), "date", "left")
    x = x.withColumn("r", F.when(F.col("b").isNotNull(), F.col("ret"))).withColumn("d", F.col("r") - F.col("b"))
    common = x.filter("b IS NOT NULL").withColumn("before", F.coalesce(F.lag("b").over(by(key)), F.lit(0.0)))
    g = common.groupBy(key).agg(F.count(F.lit(1)).alias("n"), corr("r", "b").alias("c"), F.covar_samp("r", "b").alias("cov"), F.var_samp("b").alias("v"), F.avg("r").alias("mr"), F.avg("b").alias("mb"), corr("r", "before").alias("t"), F.stddev_samp("d").alias("sd"), F.avg("d").alias("md"))
    g = e.select(key).distinct().join(g, key, "left")
    ok = F.coalesce(F.col("n") >= least, F.lit(False))
    moves = ok & (F.col("v") > 0)
    beta = F.when(moves, F.col("cov") / F.when(F.col("v") > 0, F.col("v"))).otherwise(1.0)
    te = F.col("sd") * _root()
    number = lambda c: F.coalesce(F.when(ok & ~F.isnan(c), c), F.lit(0.0))
    return g.select(
        key, number(F.col("c")).alias("corr_benchmark"), beta.alias("beta"), F.when(moves, (F.col("mr") - beta * F.col("mb")) * YEAR).otherwise(0.0).alias("alpha"), number(F.col("t")).alias("trend_score"), number(te).alias("tracking_error"),
        F.when(ok & (te > 0), F.col("md") * YEAR / F.when(te > 0, te)).otherwise(0.0).alias("info_ratio"),
    )


def behaviour(panel: DataFrame, key: str = "algo_id", least: int = 30) -> DataFrame:
    """Per key with at least `least` returns: 15 measures of behaviour, among them beta and drawdown correlation against all others.

    The others' return of a date is the mean of all but the key's own. Rolling values run over the calendar of the
    panel (63 dates with at least 30 returns, 21 with at least 10), dates without a return included, so the panel is
    filled up to the calendar; a key's rows are bounded by it.
    """
    others = panel.groupBy("date").agg(F.sum("ret").alias("_sum"), F.count("ret").alias("_count"))
    keys = panel.filter("ret IS NOT NULL").groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(key)
    own = panel.join(keys, key, "left_semi").filter("ret IS NOT NULL")
    w = by(key)
    x = own.join(others, "date").withColumn("o", F.when(F.col("_count") > 1, (F.col("_sum") - F.col("ret")) / (F.col("_count") - 1)))
    x = x.withColumn("p", F.product(1 + F.col("ret")).over(so_far(w)))
    x = x.withColumn("dd", F.col("p") / F.when(F.max("p").over(so_far(w)) != 0, F.max("p").over(so_far(w))) - 1)
    x = x.withColumn("l1", F.lag("ret", 1).over(w)).withColumn("l5", F.lag("ret", 5).over(w))
    quantile = lambda q: F.expr(f"percentile(ret, {q})")
    low = F.least("ret", F.lit(0.0))
    g = x.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.stddev_samp(low).alias("ds"), corr("ret", "l1").alias("autocorr_1"), corr("ret", "l5").alias("autocorr_5"), _skewness("ret").alias("skewness"),
        _kurtosis("ret").alias("kurtosis"), quantile(0.95).alias("hi"), quantile(0.05).alias("lo"), F.min("dd").alias("max_dd"),
    )
    both = x.filter("o IS NOT NULL").withColumn("q", F.product(1 + F.col("o")).over(so_far(w)))
    both = both.withColumn("odd", F.col("q") / F.when(F.max("q").over(so_far(w)) != 0, F.max("q").over(so_far(w))) - 1)
    b = both.groupBy(key).agg(F.count(F.lit(1)).alias("nb"), F.covar_samp("ret", "o").alias("cov"), F.var_samp("o").alias("vo"), corr("ret", "odd").alias("cd"))
    calendar = panel.select("date").distinct()
    dates = calendar.agg(F.collect_list("date").alias("_d"))  # one row, a date per day on record
    dense = with_single(keys, dates).select(key, F.explode("_d").alias("date")).join(own.select(key, "date", "ret"), [key, "date"], "left")
    enough = lambda n, k, c: F.when(F.count("ret").over(last_rows(w, n)) >= k, c)
    rolled = dense.withColumn("_m", enough(63, 30, F.avg("ret").over(last_rows(w, 63)))).withColumn("_s", enough(63, 30, F.stddev_samp("ret").over(last_rows(w, 63)))).withColumn("_v", enough(21, 10, F.stddev_samp("ret").over(last_rows(w, 21))))
    rolled = rolled.withColumn("_sh", F.when(F.col("_s") > 1e-12, F.col("_m") / F.when(F.col("_s") > 1e-12, F.col("_s")) * _root()))
    steady = rolled.groupBy(key).agg((1 / (F.stddev_samp("_sh") + 0.01)).alias("sharpe_stability"), (1 / (F.stddev_samp("_v") + 0.01)).alias("return_stability"))
    vol, down, year = F.col("s") * _root(), F.col("ds") * _root(), F.col("m") * YEAR
    sharpe = F.when(vol > 0, year / F.when(vol > 0, vol))
    known = F.col("nb") >= least
    return g.join(b, key, "left").join(steady, key, "left").select(
        key, year.alias("ann_return"), vol.alias("ann_vol"), sharpe.alias("sharpe"), F.when(down > 0, year / F.when(down > 0, down)).otherwise(sharpe).alias("sortino"), "autocorr_1", F.when(F.col("n") > 10, F.col("autocorr_5")).alias("autocorr_5"),
        "skewness", "kurtosis", F.least(F.abs(F.col("hi") / F.when(F.col("lo") != 0, F.col("lo"))), F.lit(10.0)).alias("tail_ratio"), "max_dd",
        F.when(known & (F.col("vo") > 1e-10), F.col("cov") / F.when(F.col("vo") > 1e-10, F.col("vo"))).alias("beta_universe"), F.when(known & (F.col("vo") > 1e-10), F.col("cd")).alias("beta_drawdowns"), "sharpe_stability", "return_stability",
    )


def trade_features(trades: DataFrame, days: DataFrame, window: int = 63, key: str = "algo_id") -> DataFrame:
    """(key, date, n_trades, hit_ratio, profit_factor, avg_duration, avg_pnl_pct, latent_exposure) for the dates of each key in `days`.

    trades: key, day_open, day_close, is_realized, pnl, pnl_pct, duration_days, volume. Realised trades that closed in
    (date - window, date] count; the profit factor is null without losses; latent_exposure is the volume of unrealised
    trades opened up to the date, 0 where no realised trade counts. Trades add up by day first, so a hot key's rows
    here are bounded by the calendar.
    """
    won, lost = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    closed = trades.filter("is_realized").groupBy(key, F.col("day_close").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count(won).alias("wins"), F.sum(won).alias("won"), F.sum(lost).alias("lost"), F.sum("duration_days").alias("dur"), F.count("duration_days").alias("durs"), F.sum("pnl_pct").alias("pct"), F.count("pnl_pct").alias("pcts")
    )
    latent = trades.filter("NOT is_realized").groupBy(key, F.col("day_open").alias("date")).agg(F.sum("volume").alias("latent"))
    asked = days.select(key, "date").distinct().withColumn("asked", F.lit(True))
    sums = ("n", "wins", "won", "lost", "dur", "durs", "pct", "pcts", "latent")
    x = closed.unionByName(latent, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True).groupBy(key, "date").agg(*(F.sum(c).alias(c) for c in sums), F.max("asked").alias("asked"))
    w = Window.partitionBy(key).orderBy(F.unix_date("date"))
    recent = w.rangeBetween(-(window - 1), 0)
    x = x.withColumns({f"w_{c}": F.coalesce(F.sum(c).over(recent), F.lit(0)) for c in sums[:-1]}).withColumn("w_latent", F.sum("latent").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    any_ = F.col("w_n") > 0
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b)))
    return x.filter("asked").select(key, "date", F.col("w_n").cast("long").alias("n_trades"), over("w_wins", "w_n").alias("hit_ratio"), over("w_won", "w_lost").alias("profit_factor"), over("w_dur", "w_durs").alias("avg_duration"), over("w_pct", "w_pcts").alias("avg_pnl_pct"), F.when(any_, F.coalesce("w_latent", F.lit(0.0))).otherwise(0.0).alias("latent_exposure"))


def trade_turnover(trades: DataFrame, days: DataFrame, window: int = 21, key: str = "algo_id") -> DataFrame:
    """(key, date, turnover): volume of the trades opened in (date - window, date], for the dates of each key in `days`."""
    opened = trades.groupBy(key, F.col("day_open").alias("date")).agg(F.sum("volume").alias("v"))
    asked = days.select(key, "date").distinct().withColumn("asked", F.lit(True))
    x = opened.unionByName(asked, allowMissingColumns=True).groupBy(key, "date").agg(F.sum("v").alias("v"), F.max("asked").alias("asked"))
    w = Window.partitionBy(key).orderBy(F.unix_date("date")).rangeBetween(-(window - 1), 0)
    return x.withColumn("turnover", F.coalesce(F.sum("v").over(w), F.lit(0.0))).filter("asked").select(key, "date", "turnover")


def technical_features(bars: DataFrame, key: str = "file_id") -> DataFrame:
    """Per daily bar 23 indicators: log returns, volatilities and their ratios, distances from means, RSI, Bollinger position, range, distances from the year's extremes, skewness.

    RSI by simple means of 14 moves (the first bar's counts as none), null without losses; extremes of 252 bars, from
    60 on for the distances; the true range is the greatest of its three parts that exist.
    """
    w = by(key)
    prev = lambda n: F.lag("close", n).over(w)
    mean = lambda c, n: F.avg(c).over(last_rows(w, n))
    x = bars.withColumn("rn", F.row_number().over(w)).withColumns({f"ret_{n}d": F.ln(F.col("close") / prev(n)) for n in (1, 5, 20, 60)})
    delta = F.col("close") - prev(1)
    x = x.withColumn("_up", F.coalesce(F.greatest(delta, F.lit(0.0)), F.lit(0.0))).withColumn("_down", F.coalesce(F.greatest(-delta, F.lit(0.0)), F.lit(0.0)))
    x = x.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev(1)), F.abs(F.col("low") - prev(1))))
    rows = lambda n, c: F.when(F.col("rn") >= n, c)
    x = x.withColumns({f"vol_{n}d": rows(n + 1, F.stddev_samp("ret_1d").over(last_rows(w, n)) * _root()) for n in (5, 10, 20, 60)})
    x = x.withColumns({f"_sma{n}": rows(n, mean("close", n)) for n in (5, 10, 20, 50)}).withColumn("_sd", rows(20, F.stddev_samp("close").over(last_rows(w, 20))))
    x = x.withColumn("_gain", rows(14, mean("_up", 14))).withColumn("_loss", rows(14, mean("_down", 14))).withColumn("_atr", rows(14, mean("_tr", 14)))
    year = last_rows(w, 252)
    x = x.withColumn("_hi", F.max("close").over(year)).withColumn("_lo", F.min("close").over(year)).withColumn("_skew", F.skewness("ret_1d").over(last_rows(w, 20)))
    part = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return x.select(
        key, "date", "ret_1d", "ret_5d", "ret_20d", "ret_60d", "vol_5d", "vol_10d", "vol_20d", "vol_60d", part("vol_5d", "vol_20d").alias("vol_ratio_5_20"), part("vol_10d", "vol_60d").alias("vol_ratio_10_60"),
        *((F.col("close") / F.col(f"_sma{n}") - 1).alias(f"price_vs_sma_{n}") for n in (5, 10, 20, 50)), ((F.col("_sma5") - F.col("_sma20")) / F.col("close")).alias("sma_5_20_cross"), ((F.col("_sma20") - F.col("_sma50")) / F.col("close")).alias("sma_20_50_cross"),
        F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.when(F.col("_loss") > 0, F.col("_loss")))).alias("rsi_14"), ((F.col("close") - F.col("_sma20")) / F.when(F.col("_sd") > 0, 2 * F.col("_sd"))).alias("bb_position"),
        (F.col("_atr") / F.col("close")).alias("atr_14_norm"), (F.col("close") / F.col("_hi") - 1).alias("drawdown_from_peak"), rows(60, (F.col("close") - F.col("_hi")) / F.col("close")).alias("dist_52w_high"), rows(60, (F.col("close") - F.col("_lo")) / F.col("close")).alias("dist_52w_low"),
        rows(21, F.col("_skew") * F.sqrt(F.lit(20.0 * 19)) / 18).alias("skew_20d"),
    )
