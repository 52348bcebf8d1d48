"""Queries on trades, positions, weights, as-of prices, cash flows and index reconstruction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import benchmark as bm
from ..operators import temporal as tp
from ..sources.tables import table
from .base import CLEAN, FAMILIES, MARKET, NATION_PRICES, NATION_TRADES, PANEL, TRADES, Registry, families, market, nation_panel, nation_prices, nation_trades, panel, trades

query = Registry()
QUERIES, SQL = query.queries, query.sql


def clean(spark: SparkSession, d: str) -> DataFrame:
    return tp.clean_trade_dates(trades(spark, d))


@query(f"WITH {CLEAN} SELECT trade_id, algo_id, day_open, day_close, round(volume, 6) AS volume, round(invested, 6) AS invested FROM clean")
def trades_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d).select("trade_id", "algo_id", "day_open", "day_close", "volume", "invested")


@query(f"""
WITH {TRADES}
SELECT count(*) AS n, count_if(algo_id IS NULL OR trim(algo_id) = '') AS no_name, count_if(date_open IS NULL) AS no_open, count_if(date_close IS NULL) AS no_close, count_if(date_close < date_open) AS inverted,
  count_if(volume IS NULL) AS no_volume, count_if(invested IS NULL) AS no_invested, count_if(volume < 0 OR invested < 0) AS negative FROM t""")
def trades_quality(spark: SparkSession, d: str) -> DataFrame:
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return trades(spark, d).agg(F.count(F.lit(1)).alias("n"), c("algo_id IS NULL OR trim(algo_id) = ''", "no_name"), c("date_open IS NULL", "no_open"), c("date_close IS NULL", "no_close"), c("date_close < date_open", "inverted"), c("volume IS NULL", "no_volume"), c("invested IS NULL", "no_invested"), c("volume < 0 OR invested < 0", "negative"))


_ACTIVE = (
    NATION_TRADES
    + """, days AS (SELECT DISTINCT date FROM panel), gr AS (SELECT algo_id, day_open, day_close, count(*) AS n, sum(invested) AS total FROM clean GROUP BY ALL),
active AS (SELECT days.date, g.algo_id, sum(g.n) AS n, sum(g.total) AS total FROM gr g JOIN days ON days.date BETWEEN g.day_open AND g.day_close GROUP BY ALL)"""
)
_WEIGHTS = f"{NATION_PRICES}, {_ACTIVE}, weights AS (SELECT date, algo_id, total / nullif(sum(total) OVER (PARTITION BY date), 0) AS w FROM active WHERE total IS NOT NULL)"


def active(spark: SparkSession, d: str) -> DataFrame:
    return tp.active_days(nation_trades(spark, d), nation_panel(spark, d).select("date").distinct(), "invested")


def weights(spark: SparkSession, d: str) -> DataFrame:
    return bm.shares(active(spark, d).filter("total IS NOT NULL")).select("date", "algo_id", "w")


@query(f"WITH {NATION_PRICES}, {_ACTIVE} SELECT date, algo_id, CAST(n AS BIGINT) AS n, round(total, 4) AS total FROM active", digits=4)
def positions_interval(spark: SparkSession, d: str) -> DataFrame:
    return active(spark, d)


@query(f"WITH {_WEIGHTS} SELECT date, algo_id, round(w, 8) AS w FROM weights", digits=8)
def benchmark_weights(spark: SparkSession, d: str) -> DataFrame:
    return weights(spark, d)


@query(f"""
WITH {_WEIGHTS}, cal AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM weights)),
x AS (SELECT c.date, coalesce(a.w, 0) - coalesce(b.w, 0) AS dw FROM cal c JOIN (SELECT DISTINCT algo_id FROM weights) k ON true
  LEFT JOIN weights a ON a.date = c.date AND a.algo_id = k.algo_id LEFT JOIN weights b ON b.date = c.prev AND b.algo_id = k.algo_id WHERE c.prev IS NOT NULL)
SELECT date, round(sum(abs(dw)) / 2, 8) + 0.0 AS turnover FROM x GROUP BY date UNION ALL SELECT min(date), 0.0 FROM cal""", digits=8)
def benchmark_turnover(spark: SparkSession, d: str) -> DataFrame:
    return bm.turnover(weights(spark, d))


@query(f"""
WITH {_WEIGHTS}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, algo_id) AS k FROM weights)
SELECT date, round(sum(w * w), 8) AS hhi, count_if(w > 0.001) AS n_positions, round(sum(w) FILTER (k <= 5), 8) AS top_5, round(max(w), 8) AS max_weight, round(1 / sum(w * w), 8) AS effective_n FROM r GROUP BY date""", digits=8)
def benchmark_concentration(spark: SparkSession, d: str) -> DataFrame:
    return bm.concentration(weights(spark, d))


@query(f"""
WITH {_WEIGHTS}, cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT date FROM weights INTERSECT SELECT date FROM panel))
SELECT c.date, round(s.ret, 8) + 0.0 AS ret FROM cal c LEFT JOIN (
  SELECT k.nx AS date, sum(w.w * p.ret) AS ret FROM weights w JOIN cal k ON k.date = w.date JOIN panel p ON p.date = k.nx AND p.algo_id = w.algo_id GROUP BY ALL) s ON s.date = c.date""", digits=8)
def benchmark_daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return bm.lagged_portfolio_returns(weights(spark, d), nation_panel(spark, d).select("date", "algo_id", "ret"))


@query(f"""
WITH {_WEIGHTS}, l AS (SELECT algo_id, date, w, lag(w) OVER (PARTITION BY algo_id ORDER BY date) AS pw FROM weights),
c AS (SELECT date, sum(abs(w - coalesce(pw, 0))) AS moved FROM l GROUP BY date), gap AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM c WHERE moved > 0.01)
SELECT count(*) AS n_rebalances, round(avg(date - prev), 6) AS mean_days FROM gap""")
def rebalance_frequency(spark: SparkSession, d: str) -> DataFrame:
    change = F.abs(F.col("w") - F.coalesce(F.lag("w").over(Window.partitionBy("algo_id").orderBy("date")), F.lit(0.0)))
    moved = weights(spark, d).withColumn("c", change).groupBy("date").agg(F.sum("c").alias("moved")).filter("moved > 0.01")
    gaps = moved.withColumn("gap", F.datediff("date", F.lag("date").over(Window.orderBy("date"))))
    return gaps.agg(F.count(F.lit(1)).alias("n_rebalances"), F.avg("gap").alias("mean_days"))


@query(f"""WITH {_WEIGHTS}, fam AS (SELECT 'N' || n_nationkey AS algo_id, r_name AS family FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT w.algo_id, f.family, round(avg(w), 8) AS mean_w, round(stddev_samp(w), 8) AS std_w, round(min(w), 8) AS min_w, round(max(w), 8) AS max_w, count(*) AS n
FROM weights w LEFT JOIN fam f USING (algo_id) GROUP BY w.algo_id, f.family""", digits=8)
def weight_profile(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    fam = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("algo_id"), F.col("r_name").alias("family"))
    j = weights(spark, d).join(fam, "algo_id", "left")
    return j.groupBy("algo_id", "family").agg(F.avg("w").alias("mean_w"), F.stddev_samp("w").alias("std_w"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.count(F.lit(1)).alias("n"))


# Prices as of the opening and closing of trades. Openings are moved back a day so that some have no price yet.
_OPENED = f"{NATION_PRICES}, {NATION_TRADES}, t AS (SELECT trade_id, algo_id, CAST(day_open - INTERVAL 1 DAY AS DATE) AS at_open, day_close AS at_close, invested FROM clean)"


def _opened(spark: SparkSession, d: str) -> DataFrame:
    return nation_trades(spark, d).select("trade_id", "algo_id", F.date_sub("day_open", 1).alias("at_open"), F.col("day_close").alias("at_close"), "invested")


@query(f"""
WITH {_OPENED}, q AS (SELECT t.trade_id, t.algo_id, arg_max(px.close, px.date) AS c FROM t LEFT JOIN px ON px.algo_id = t.algo_id AND px.date <= t.at_open GROUP BY ALL),
f AS (SELECT algo_id, arg_min(close, date) AS c FROM px GROUP BY algo_id)
SELECT q.trade_id, round(q.c, 4) AS close, round(coalesce(q.c, f.c), 4) AS close_or_first FROM q LEFT JOIN f USING (algo_id)""", digits=4)
def asof_price(spark: SparkSession, d: str) -> DataFrame:
    a = tp.asof_join(_opened(spark, d), nation_prices(spark, d), ["algo_id"], "at_open", "date", ["close"], fallback="both")
    return a.select("trade_id", "close", "close_or_first")


@query(f"WITH {_OPENED} SELECT t.trade_id, round(arg_min(px.close, px.date), 4) AS close FROM t LEFT JOIN px ON px.algo_id = t.algo_id AND px.date > t.at_open GROUP BY t.trade_id", digits=4)
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return tp.asof_join(_opened(spark, d), nation_prices(spark, d), ["algo_id"], "at_open", "date", ["close"], direction="forward", strict=True).select("trade_id", "close")


@query(f"""
WITH {_OPENED},
a AS (SELECT t.*, arg_max(px.close, px.date) AS entry FROM t LEFT JOIN px ON px.algo_id = t.algo_id AND px.date <= t.at_open WHERE t.at_open <= DATE '1999-12-31' GROUP BY ALL),
b AS (SELECT a.*, least(at_close, DATE '1999-12-31') AS at FROM a),
c AS (SELECT b.trade_id, b.at_close <= DATE '1999-12-31' AS is_realized, b.invested, b.entry, arg_max(px.close, px.date) AS exit, CAST(b.at - b.at_open AS INT) AS duration_days FROM b LEFT JOIN px ON px.algo_id = b.algo_id AND px.date <= b.at GROUP BY ALL)
SELECT trade_id, is_realized, round(exit / nullif(entry, 0) - 1, 8) + 0.0 AS pnl_pct, round(invested * (exit / nullif(entry, 0) - 1), 2) + 0.0 AS pnl, duration_days FROM c""", digits=8)
def trade_pnl(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.lit("1999-12-31").cast("date")
    p = nation_prices(spark, d)
    t = _opened(spark, d).filter(F.col("at_open") <= cutoff).withColumn("at", F.least("at_close", cutoff))
    t = tp.asof_join(t, p.withColumnRenamed("close", "entry"), ["algo_id"], "at_open", "date", ["entry"])
    t = tp.asof_join(t, p.withColumnRenamed("close", "exit"), ["algo_id"], "at", "date", ["exit"])
    gain = F.col("exit") / F.when(F.col("entry") != 0, F.col("entry")) - 1
    return t.select("trade_id", (F.col("at_close") <= cutoff).alias("is_realized"), gain.alias("pnl_pct"), F.round(F.col("invested") * gain, 2).alias("pnl"), F.datediff("at", "at_open").alias("duration_days"))


@query(f"""
WITH {CLEAN}, k AS (SELECT algo_id, day_close, count(*) AS n, sum(invested) AS s, sum(day_close - day_open) AS dur FROM clean WHERE date_close IS NOT NULL GROUP BY ALL)
SELECT algo_id, day_close, CAST(sum(n) OVER w AS BIGINT) AS n_63d, round(sum(s) OVER w, 4) AS invested_63d, round(sum(dur) OVER w * 1.0 / sum(n) OVER w, 6) AS mean_days_63d
FROM k WINDOW w AS (PARTITION BY algo_id ORDER BY day_close RANGE BETWEEN INTERVAL 62 DAY PRECEDING AND CURRENT ROW)""")
def rolling_trades_63d(spark: SparkSession, d: str) -> DataFrame:
    c = clean(spark, d).filter("date_close IS NOT NULL")
    k = c.groupBy("algo_id", "day_close").agg(F.count(F.lit(1)).alias("n"), F.sum("invested").alias("s"), F.sum(F.datediff("day_close", "day_open")).alias("dur"))
    out = tp.rows_in_days(k, "algo_id", "day_close", 63, {"n_63d": F.sum("n"), "s_63": F.sum("s"), "dur_63": F.sum("dur")})
    return out.select("algo_id", "day_close", "n_63d", F.round("s_63", 4).alias("invested_63d"), (F.col("dur_63") / F.col("n_63d")).alias("mean_days_63d"))


def _schedule(n: int) -> None:
    sql = f"""
WITH RECURSIVE {PANEL}, days AS (SELECT DISTINCT date FROM panel), s AS (
  SELECT min(date) AS date FROM days UNION ALL SELECT (SELECT min(x.date) FROM days x WHERE x.date >= s.date + {n}) FROM s WHERE s.date IS NOT NULL
) SELECT date FROM s WHERE date IS NOT NULL"""

    @query(sql, name=f"rebalance_schedule_{n}d")
    def schedule(spark: SparkSession, d: str) -> DataFrame:
        return tp.rebalance_schedule(panel(spark, d), n)


for _n in (5, 21, 63):
    _schedule(_n)


@query(f"""
WITH {CLEAN}, m AS (SELECT algo_id, day_open AS date, volume AS v FROM clean WHERE volume IS NOT NULL UNION ALL SELECT algo_id, day_close, -volume FROM clean WHERE volume IS NOT NULL AND date_close IS NOT NULL),
g AS (SELECT algo_id, date, sum(v) AS v FROM m GROUP BY ALL)
SELECT algo_id, date, round(greatest(round(sum(v) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING), 6), 0), 6) + 0.0 AS units FROM g""")
def holdings_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return bm.holdings(clean(spark, d))


@query(f"""
WITH {TRADES}, {FAMILIES}, j AS (SELECT t.*, coalesce(f.family, 'unmapped') AS family FROM t LEFT JOIN fam f USING (algo_id))
SELECT family, count(*) AS n, round(sum(volume), 6) AS volume, round(100 * sum(volume) / sum(sum(volume)) OVER (), 6) AS pct, count(DISTINCT algo_id) AS algos FROM j GROUP BY family""")
def composition_by_family(spark: SparkSession, d: str) -> DataFrame:
    j = trades(spark, d).join(families(spark, d), "algo_id", "left").withColumn("family", F.coalesce("family", F.lit("unmapped")))
    g = j.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.countDistinct("algo_id").alias("algos"))
    return g.withColumn("pct", 100 * F.col("volume") / F.sum("volume").over(Window.partitionBy(F.lit(1))))


@query(f"""
WITH {TRADES}, {FAMILIES}, j AS (SELECT CAST(date_trunc('month', date_open) AS DATE) AS month, coalesce(f.family, 'unmapped') AS family, volume FROM t LEFT JOIN fam f USING (algo_id) WHERE date_open IS NOT NULL)
SELECT month, family, round(coalesce(sum(volume), 0), 6) AS volume FROM j GROUP BY month, family""")
def family_month_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """(month, family, volume): every family found, in rows; trades without one as `unmapped`."""
    j = trades(spark, d).filter("date_open IS NOT NULL").join(families(spark, d), "algo_id", "left").withColumn("family", F.coalesce("family", F.lit("unmapped")))
    return j.groupBy(F.trunc("date_open", "MM").alias("month"), "family").agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))


@query(f"""
WITH {TRADES}, a AS (SELECT algo_id, sum(invested) AS v FROM t WHERE algo_id IS NOT NULL AND invested IS NOT NULL GROUP BY algo_id),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC, algo_id) AS k, sum(v) OVER () AS tot, sum(v) OVER (ORDER BY v DESC, algo_id ROWS UNBOUNDED PRECEDING) AS cum FROM a)
SELECT round(sum(v) FILTER (k <= 5) / max(tot), 8) AS top_5, round(sum(v) FILTER (k <= 10) / max(tot), 8) AS top_10, round(sum(v) FILTER (k <= 20) / max(tot), 8) AS top_20,
  round(10000 * sum(v * v) / (max(tot) * max(tot)), 6) AS hhi, round(max(tot) * max(tot) / sum(v * v), 6) AS effective_n,
  min(k) FILTER (cum >= 0.5 * tot) AS n_50, min(k) FILTER (cum >= 0.8 * tot) AS n_80, min(k) FILTER (cum >= 0.95 * tot) AS n_95 FROM r""", digits=8)
def concentration_topn(spark: SparkSession, d: str) -> DataFrame:
    a = trades(spark, d).filter("algo_id IS NOT NULL AND invested IS NOT NULL").groupBy("algo_id").agg(F.sum("invested").alias("v"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("v").desc(), "algo_id")  # one row per algorithm
    r = a.withColumn("k", F.row_number().over(w)).withColumn("cum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot", F.sum("v").over(Window.partitionBy(F.lit(1))))
    tot = F.max("tot")
    top = [(F.sum(F.when(F.col("k") <= n, F.col("v"))) / tot).alias(f"top_{n}") for n in (5, 10, 20)]
    need = [F.min(F.when(F.col("cum") >= p * F.col("tot"), F.col("k"))).cast("long").alias(f"n_{int(p * 100)}") for p in (0.5, 0.8, 0.95)]
    square = F.sum(F.col("v") * F.col("v"))
    return r.agg(*top, F.round(10000 * square / (tot * tot), 6).alias("hhi"), F.round(tot * tot / square, 6).alias("effective_n"), *need)


@query(f"""
WITH {CLEAN}, h AS (SELECT algo_id, day_close - day_open AS days FROM clean WHERE date_close IS NOT NULL)
SELECT algo_id, count(*) AS n, round(avg(days), 6) AS mean_days, round(quantile_cont(days, 0.5), 6) AS median_days, round(quantile_cont(days, 0.9), 6) AS p90_days,
  round(avg(CAST(days <= 1 AS INT)), 6) AS to_1, round(avg(CAST(days > 1 AND days <= 7 AS INT)), 6) AS to_7, round(avg(CAST(days > 7 AS INT)), 6) AS longer FROM h GROUP BY algo_id""")
def holding_profile(spark: SparkSession, d: str) -> DataFrame:
    h = clean(spark, d).filter("date_close IS NOT NULL").withColumn("days", F.datediff("day_close", "day_open"))
    share = lambda c, n: F.avg(F.expr(c).cast("int")).alias(n)
    return h.groupBy("algo_id").agg(F.count(F.lit(1)).alias("n"), F.avg("days").alias("mean_days"), F.expr("percentile(days, 0.5)").alias("median_days"), F.expr("percentile(days, 0.9)").alias("p90_days"), share("days <= 1", "to_1"), share("days > 1 AND days <= 7", "to_7"), share("days > 7", "longer"))


#: Phases by the year of the opening day: until 2020, 2021 to 2022, later.
_PHASE = "CASE WHEN year(day_open) <= 2020 THEN 'seed' WHEN year(day_open) <= 2022 THEN 'scale' ELSE 'mature' END"


@query(f"""
WITH {CLEAN}, p AS (SELECT DISTINCT algo_id, {_PHASE} AS phase FROM clean), f AS (SELECT algo_id, bool_or(phase = 'seed') AS a, bool_or(phase = 'scale') AS b, bool_or(phase = 'mature') AS c FROM p GROUP BY algo_id)
SELECT count_if(a) AS seed, count_if(b) AS scale, count_if(c) AS mature, count_if(a AND NOT b) AS seed_not_scale, count_if(b AND NOT a) AS scale_not_seed, count_if(b AND c) AS scale_and_mature, count_if(c AND NOT a AND NOT b) AS only_mature FROM f""")
def phase_rotation(spark: SparkSession, d: str) -> DataFrame:
    p = clean(spark, d).withColumn("phase", F.expr(_PHASE))
    f = p.groupBy("algo_id").agg(*(F.bool_or(F.col("phase") == x).alias(y) for x, y in (("seed", "a"), ("scale", "b"), ("mature", "c"))))
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return f.agg(c("a", "seed"), c("b", "scale"), c("c", "mature"), c("a AND NOT b", "seed_not_scale"), c("b AND NOT a", "scale_not_seed"), c("b AND c", "scale_and_mature"), c("c AND NOT a AND NOT b", "only_mature"))


@query(f"""
WITH {CLEAN}, x AS (SELECT *, {_PHASE} AS phase FROM clean), m AS (SELECT phase, count(*) AS n, round(sum(invested), 2) AS invested, count(DISTINCT algo_id) AS algos, min(day_open) AS first, max(day_close) AS last FROM x GROUP BY phase) SELECT * FROM m""", digits=2)
def phase_summary(spark: SparkSession, d: str) -> DataFrame:
    x = clean(spark, d).withColumn("phase", F.expr(_PHASE))
    return x.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("invested").alias("invested"), F.countDistinct("algo_id").alias("algos"), F.min("day_open").alias("first"), F.max("day_close").alias("last"))


@query(f"""
WITH {TRADES}, m AS (SELECT CAST(date_trunc('month', date_open) AS DATE) AS month, algo_id, count(*) AS n, sum(invested) AS inv, sum(equity_eod) AS eq, count(invested) AS ni, count(equity_eod) AS ne FROM t WHERE date_open IS NOT NULL AND algo_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, algo_id) AS k, sum(n) OVER (PARTITION BY month) AS tot FROM m)
SELECT month, CAST(sum(n) AS BIGINT) AS n, count(*) AS products, round(sum(inv) / sum(ni) / (sum(eq) / sum(ne)), 8) AS leverage, round(sum((n * 1.0 / tot) * (n * 1.0 / tot)), 8) AS hhi,
  round(sum(n) FILTER (k <= 5) * 1.0 / max(tot), 8) AS top_5, max(algo_id) FILTER (k = 1) AS top_product FROM r GROUP BY month""", digits=8)
def monthly_trade_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).filter("date_open IS NOT NULL AND algo_id IS NOT NULL")
    m = t.groupBy(F.trunc("date_open", "MM").alias("month"), "algo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("invested").alias("inv"), F.sum("equity_eod").alias("eq"), F.count("invested").alias("ni"), F.count("equity_eod").alias("ne"))
    part = Window.partitionBy("month")
    r = m.withColumn("k", F.row_number().over(part.orderBy(F.col("n").desc(), "algo_id"))).withColumn("tot", F.sum("n").over(part))
    share = F.col("n") / F.col("tot")
    return r.groupBy("month").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("products"), (F.sum("inv") / F.sum("ni") / (F.sum("eq") / F.sum("ne"))).alias("leverage"), F.sum(share * share).alias("hhi"), (F.sum(F.when(F.col("k") <= 5, F.col("n"))) / F.max("tot")).alias("top_5"), F.max(F.when(F.col("k") == 1, F.col("algo_id"))).alias("top_product"))


# The fund: last equity of each day of the busiest algorithm's log, with the market's return of that day.
_FUND = (
    MARKET
    + ", "
    + TRADES
    + """, day AS (SELECT CAST(date_open AS DATE) AS date, arg_max(equity_eod, (date_open, trade_id)) AS equity FROM t WHERE date_open IS NOT NULL AND equity_eod IS NOT NULL GROUP BY ALL),
fund AS (SELECT day.date, day.equity, m.ret FROM day LEFT JOIN market m USING (date))"""
)
_FLOWS = (
    _FUND
    + """, f0 AS (SELECT *, lag(equity) OVER (ORDER BY date) AS pe FROM fund), flows AS (SELECT date, equity, ret, pe, coalesce(equity - pe * (1 + coalesce(ret, 0)), 0) AS flow FROM f0)"""
)


def fund(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).filter("date_open IS NOT NULL AND equity_eod IS NOT NULL")
    day = t.groupBy(F.col("date_open").cast("date").alias("date")).agg(F.max_by("equity_eod", F.struct("date_open", "trade_id")).alias("equity"))
    return day.join(market(spark, d).select("date", "ret"), "date", "left")


def flows(spark: SparkSession, d: str) -> DataFrame:
    return bm.cash_flows(fund(spark, d))


@query(f"""
WITH {_FLOWS}, k AS (SELECT *, CASE WHEN flow > 100 THEN 'INFLOW' WHEN flow < -100 THEN 'OUTFLOW' ELSE 'NONE' END AS kind FROM flows)
SELECT date, round(equity, 4) AS equity, round(flow, 4) + 0.0 AS flow, kind, round(sum(CASE WHEN kind = 'INFLOW' THEN flow ELSE 0 END) OVER w, 2) + 0.0 AS cum_in, round(sum(CASE WHEN kind = 'OUTFLOW' THEN flow ELSE 0 END) OVER w, 2) + 0.0 AS cum_out
FROM k WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""", digits=4)
def gips_cashflow(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select("date", "equity", "flow", "kind", F.round("cum_in", 2).alias("cum_in"), F.round("cum_out", 2).alias("cum_out"))


@query(f"""
WITH {_FLOWS}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, flow, date, equity FROM flows)
SELECT month, round(sum(greatest(flow, 0)), 2) + 0.0 AS inflow, round(sum(least(flow, 0)), 2) + 0.0 AS outflow, count_if(abs(flow) > 100) AS n_flows, round(arg_min(equity, date), 4) AS first_equity, round(arg_max(equity, date), 4) AS last_equity FROM m GROUP BY month""", digits=4)
def monthly_cashflows(spark: SparkSession, d: str) -> DataFrame:
    x = flows(spark, d).withColumn("month", F.trunc("date", "MM"))
    return x.groupBy("month").agg(F.round(F.sum(F.greatest("flow", F.lit(0.0))), 2).alias("inflow"), F.round(F.sum(F.least("flow", F.lit(0.0))), 2).alias("outflow"), F.count_if(F.abs("flow") > 100).alias("n_flows"), F.min_by("equity", "date").alias("first_equity"), F.max_by("equity", "date").alias("last_equity"))


@query(f"WITH {_FLOWS}, r AS (SELECT date, (equity - pe - flow) / nullif(pe + flow / 2, 0) AS x FROM flows) SELECT date, CASE WHEN x IS NOT NULL THEN round(greatest(least(x, 0.5), -0.5), 8) + 0.0 END AS dietz FROM r", digits=8)
def dietz_daily(spark: SparkSession, d: str) -> DataFrame:
    return bm.dietz_daily(flows(spark, d)).select("date", "dietz")


@query(f"""
WITH {_FLOWS}, x AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, date, equity, CASE WHEN abs(flow) > 100 THEN flow ELSE 0 END AS c, day(last_day(date)) AS td FROM flows),
m AS (SELECT month, arg_max(equity, date) AS ev, arg_min(equity, date) AS f, sum(c) AS c, sum(c * (td - day(date)) / td) AS cw FROM x GROUP BY month), b AS (SELECT *, coalesce(lag(ev) OVER (ORDER BY month), f) AS bv FROM m)
SELECT month, round((ev - bv - c) / nullif(bv + cw, 0), 8) + 0.0 AS ret FROM b""", digits=8)
def dietz_linked_monthly(spark: SparkSession, d: str) -> DataFrame:
    return bm.dietz_monthly(flows(spark, d))


@query(f"""
WITH {_FLOWS}, x AS (SELECT *, sum(CASE WHEN abs(flow) / nullif(abs(pe), 0) > 0.01 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS part FROM flows)
SELECT CAST(part AS BIGINT) AS part, min(date) AS first, max(date) AS last, round(product(1 + coalesce(ret, 0)) - 1, 8) + 0.0 AS ret FROM x GROUP BY part""", digits=8)
def twr_subperiods(spark: SparkSession, d: str) -> DataFrame:
    return bm.twr_subperiods(flows(spark, d))


def _index(name: str, weight_sql: str, weight) -> None:
    sql = f"""
WITH {NATION_PRICES}, {_ACTIVE}, v AS (SELECT algo_id, date, stddev_samp(ret) OVER w AS sd, count(*) OVER w AS k FROM panel WINDOW w AS (PARTITION BY algo_id ORDER BY date ROWS 59 PRECEDING)),
x AS (SELECT p.date, p.ret, {weight_sql} AS w FROM panel p JOIN active a USING (date, algo_id) JOIN v USING (date, algo_id)),
r AS (SELECT date, sum(w * ln(1 + ret)) / sum(w) AS lr, count(*) AS coverage FROM x WHERE w > 0 AND ret > -1 GROUP BY date)
SELECT date, round(sum(lr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 8) + 0.0 AS log_index, coverage FROM r"""

    @query(sql, name=f"recon_{name}", digits=8)
    def recon(spark: SparkSession, d: str) -> DataFrame:
        w = Window.partitionBy("algo_id").orderBy("date").rowsBetween(-59, 0)
        r = nation_panel(spark, d).withColumn("sd", F.stddev_samp("ret").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
        return bm.weighted_index(active(spark, d), r, weight(), base=1.0).select("date", F.ln("index").alias("log_index"), "coverage")


_index("volume", "CAST(a.n AS DOUBLE)", lambda: F.col("n").cast("double"))
_index("value", "a.total", lambda: F.col("total"))
_index("equal", "1.0", lambda: F.lit(1.0))
_index("invvol", "CASE WHEN v.k >= 20 AND v.sd > 1e-8 THEN 1 / v.sd ELSE 1.0 END", lambda: F.when((F.col("k") >= 20) & (F.col("sd") > 1e-8), 1 / F.when(F.col("sd") > 1e-8, F.col("sd"))).otherwise(1.0))


@query(f"""
WITH {MARKET}, e AS (SELECT date, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM market), x AS (SELECT date, v / max(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
low AS (SELECT min(dd) AS m, arg_min(date, (dd, date)) AS t FROM x), a AS (SELECT min(x.date) AS r FROM x, low WHERE x.date > low.t AND x.dd > -0.001)
SELECT low.t AS trough, round(low.m, 8) AS max_drawdown, a.r AS recovered, CAST(a.r - low.t AS INT) AS days FROM low, a""", digits=8)
def recovery_days(spark: SparkSession, d: str) -> DataFrame:
    v = F.product(1 + F.col("ret")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return bm.recovery(market(spark, d).withColumn("v", v), "v")


@query(f"""
WITH {_WEIGHTS}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, algo_id, avg(w) AS w FROM weights GROUP BY ALL), q AS (SELECT *, w / sum(w) OVER (PARTITION BY month) AS s, row_number() OVER (PARTITION BY month ORDER BY w DESC, algo_id) AS k FROM m WHERE w > 0)
SELECT month, count(*) AS n, round(sum(s * s), 8) AS hhi, round(1 / sum(s * s), 6) AS effective_n, round(sum(s) FILTER (k <= 5), 8) AS top_5, round(sum(s) FILTER (k <= 10), 8) AS top_10, max(algo_id) FILTER (k = 1) AS top_product FROM q GROUP BY month""", digits=8)
def monthly_selection(spark: SparkSession, d: str) -> DataFrame:
    m = weights(spark, d).groupBy(F.trunc("date", "MM").alias("month"), "algo_id").agg(F.avg("w").alias("w")).filter("w > 0")
    part = Window.partitionBy("month")
    q = m.withColumn("s", F.col("w") / F.sum("w").over(part)).withColumn("k", F.row_number().over(part.orderBy(F.col("w").desc(), "algo_id")))
    square = F.sum(F.col("s") * F.col("s"))
    return q.groupBy("month").agg(F.count(F.lit(1)).alias("n"), square.alias("hhi"), F.round(1 / square, 6).alias("effective_n"), F.sum(F.when(F.col("k") <= 5, F.col("s"))).alias("top_5"), F.sum(F.when(F.col("k") <= 10, F.col("s"))).alias("top_10"), F.max(F.when(F.col("k") == 1, F.col("algo_id"))).alias("top_product"))
