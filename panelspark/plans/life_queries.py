"""Queries on the life of algorithms, their trades, and indicators of price files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators import panel as px
from ..operators import temporal as tp
from .base import BARS, ENRICHED, MARKET, NATION_PRICES, NATION_TRADES, PANEL, Registry, bars, market, nation_prices, nation_trades, panel

query = Registry()
QUERIES, SQL = query.queries, query.sql
_R = "sqrt(252)"


@query(f"""
WITH {PANEL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)), tot AS (SELECT count(*) * 1.0 AS n FROM cal),
x AS (SELECT algo_id, i, i - lag(i) OVER (PARTITION BY algo_id ORDER BY i) AS st FROM panel JOIN cal USING (date)),
g AS (SELECT algo_id, min(i) AS a, max(i) AS z, count(*) AS k, count(*) FILTER (st > 1) AS gaps, coalesce(sum(st - 1) FILTER (st > 1), 0) AS missing FROM x GROUP BY algo_id)
SELECT algo_id, round(a / n, 6) AS start_idx, round(z / n, 6) AS end_idx, round((z - a + 1) / n, 6) AS duration_ratio, round(k * 1.0 / (z - a + 1), 6) AS active_ratio, gaps AS n_gaps, round(missing * 1.0 / (z - a + 1), 6) AS gap_ratio, k AS n_active_days FROM g, tot""")
def life_activity(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    return lc.activity(p, p.select("date"))


@query(f"""
WITH {ENRICHED}, q AS (SELECT algo_id, quantile_cont(ret, 0.05) AS v FROM enriched GROUP BY algo_id),
g AS (
  SELECT algo_id, count(*) AS n, avg(ret) * 252 AS y, stddev_samp(ret) * {_R} AS vol, stddev_samp(ret) FILTER (ret < 0) * {_R} AS dv, count(*) FILTER (ret < 0) AS losses, product(1 + ret) - 1 AS total, min(dd) AS mdd, sqrt(avg(dd * dd)) AS ulcer, any_value(v) AS v,
    avg(ret) FILTER (ret <= v) AS cv, CASE WHEN count(*) > 2 AND stddev_pop(ret) > 0 THEN skewness(ret) END AS sk, CASE WHEN count(*) > 3 AND stddev_pop(ret) > 0 THEN kurtosis(ret) END AS ku, avg(CAST(ret > 0 AS INT)) AS hit, coalesce(sum(ret) FILTER (ret > 0), 0) AS won, coalesce(-sum(ret) FILTER (ret < 0), 0) AS lost,
    covar_pop(p, rn) / nullif(var_pop(rn), 0) AS slope, pow(corr(p, rn), 2) AS r2
  FROM enriched JOIN q USING (algo_id) GROUP BY algo_id)
SELECT algo_id, round(total, 6) + 0.0 AS total_return, round(y, 6) + 0.0 AS ann_return, round(vol, 6) AS ann_vol, round(CASE WHEN vol > 0 THEN y / vol ELSE 0 END, 6) + 0.0 AS sharpe,
  round(CASE WHEN CASE WHEN losses > 0 THEN dv ELSE vol END > 0 THEN y / CASE WHEN losses > 0 THEN dv ELSE vol END ELSE 0 END, 6) + 0.0 AS sortino, round(mdd, 6) + 0.0 AS max_dd, round(ulcer, 6) AS ulcer_index, round(v, 6) + 0.0 AS var_95, round(cv, 6) + 0.0 AS cvar_95,
  round(sk, 6) + 0.0 AS skewness, round(ku, 6) + 0.0 AS kurtosis, round(hit, 6) AS hit_ratio, round(CASE WHEN lost > 0 THEN least(won / lost, 10) WHEN won > 0 THEN 10 ELSE 1 END, 6) AS profit_factor,
  round(CASE WHEN n > 10 THEN slope * 252 ELSE 0 END, 6) + 0.0 AS equity_slope, round(CASE WHEN n > 10 THEN r2 ELSE 0 END, 6) AS equity_r2 FROM g""")
def life_performance(spark: SparkSession, d: str) -> DataFrame:
    return lc.performance(px.enrich(panel(spark, d)))


@query(f"""
WITH {ENRICHED}, c AS (SELECT algo_id, count(*) AS n, count(*) // 3 AS sz FROM enriched GROUP BY algo_id),
a AS (SELECT e.algo_id, rn, ret, c.n, c.sz, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM enriched e JOIN c USING (algo_id) WINDOW w AS (PARTITION BY e.algo_id ORDER BY date ROWS 20 PRECEDING)),
b AS (SELECT *, CASE WHEN rn >= 21 THEN m * 252 END AS rm, CASE WHEN rn >= 21 AND s > 0 THEN m * 252 / (s * {_R}) END AS rs FROM a),
g AS (
  SELECT algo_id, any_value(n) AS n, any_value(least(21, sz)) AS el, avg(ret) FILTER (n < 30 OR rn <= sz) * 252 AS y0, avg(ret) FILTER (n < 30 OR (rn > sz AND rn <= 2 * sz)) * 252 AS y1, avg(ret) FILTER (n < 30 OR rn > 2 * sz) * 252 AS y2,
    stddev_samp(ret) FILTER (n < 30 OR rn <= sz) * {_R} AS v0, stddev_samp(ret) FILTER (n < 30 OR rn > 2 * sz) * {_R} AS v2, stddev_samp(rs) AS ss, stddev_samp(rm) AS sm, avg(ret) FILTER (rn <= least(21, sz)) AS me, stddev_samp(ret) FILTER (rn <= least(21, sz)) AS se
  FROM b GROUP BY algo_id),
h AS (SELECT *, CASE WHEN n >= 30 AND v0 > 0 THEN y0 / v0 ELSE 0 END AS s0, CASE WHEN n >= 30 AND v2 > 0 THEN y2 / v2 ELSE 0 END AS s2 FROM g)
SELECT algo_id, round(y0, 6) + 0.0 AS return_first_third, round(y1, 6) + 0.0 AS return_middle_third, round(y2, 6) + 0.0 AS return_last_third, round(v0, 6) AS vol_first_third, round(v2, 6) AS vol_last_third, round(s0, 6) + 0.0 AS sharpe_first_third, round(s2, 6) + 0.0 AS sharpe_last_third,
  round(CASE WHEN n >= 30 THEN y2 - y0 ELSE 0 END, 6) + 0.0 AS return_decay, round(CASE WHEN n >= 30 THEN s2 - s0 ELSE 0 END, 6) + 0.0 AS sharpe_decay, round(CASE WHEN n >= 30 THEN v2 - v0 ELSE 0 END, 6) + 0.0 AS vol_change,
  round(CASE WHEN n >= 63 THEN 1 / (ss + 0.01) ELSE 0 END, 6) AS sharpe_stability, round(CASE WHEN n >= 63 THEN 1 / (sm + 0.01) ELSE 0 END, 6) AS return_stability, round(CASE WHEN el > 5 THEN me * 252 ELSE 0 END, 6) + 0.0 AS early_return,
  round(CASE WHEN el > 5 AND se > 0 THEN me * 252 / (se * {_R}) ELSE 0 END, 6) + 0.0 AS early_sharpe FROM h""")
def life_transition(spark: SparkSession, d: str) -> DataFrame:
    return lc.transition(px.enrich(panel(spark, d)))


@query(f"""
WITH {MARKET}, x AS (SELECT p.algo_id, p.ret AS r, m.ret AS b, coalesce(lag(m.ret) OVER (PARTITION BY p.algo_id ORDER BY p.date), 0) AS l FROM panel p JOIN market m USING (date)),
g AS (SELECT algo_id, count(*) AS n, corr(r, b) AS c, covar_samp(r, b) / nullif(var_samp(b), 0) AS be, avg(r) AS mr, avg(b) AS mb, corr(r, l) AS t, stddev_samp(r - b) * {_R} AS te, avg(r - b) * 252 AS ex FROM x GROUP BY algo_id)
SELECT algo_id, round(CASE WHEN n >= 20 AND isfinite(c) THEN c ELSE 0 END, 6) + 0.0 AS corr_benchmark, round(CASE WHEN n >= 20 THEN coalesce(be, 1) ELSE 1 END, 6) + 0.0 AS beta, round(CASE WHEN n >= 20 AND be IS NOT NULL THEN (mr - be * mb) * 252 ELSE 0 END, 6) + 0.0 AS alpha,
  round(CASE WHEN n >= 20 AND isfinite(t) THEN t ELSE 0 END, 6) + 0.0 AS trend_score, round(CASE WHEN n >= 20 THEN te ELSE 0 END, 6) AS tracking_error, round(CASE WHEN n >= 20 AND te > 0 THEN ex / te ELSE 0 END, 6) + 0.0 AS info_ratio FROM g""")
def life_against_market(spark: SparkSession, d: str) -> DataFrame:
    return lc.against(panel(spark, d), market(spark, d))


@query(f"""
WITH {ENRICHED}, tot AS (SELECT date, sum(ret) AS s, count(*) AS c FROM panel GROUP BY date), k AS (SELECT algo_id, count(*) AS n FROM panel GROUP BY algo_id HAVING count(*) >= 30),
x AS (SELECT e.algo_id, e.date, e.ret, e.dd, k.n, CASE WHEN c > 1 THEN (s - e.ret) / (c - 1) END AS o, lag(e.ret, 1) OVER w AS l1, lag(e.ret, 5) OVER w AS l5 FROM enriched e JOIN k USING (algo_id) JOIN tot USING (date) WINDOW w AS (PARTITION BY e.algo_id ORDER BY e.date)),
g AS (SELECT algo_id, any_value(n) AS n, avg(ret) * 252 AS y, stddev_samp(ret) * {_R} AS v, stddev_samp(least(ret, 0)) * {_R} AS dv, corr(ret, l1) AS a1, corr(ret, l5) AS a5, CASE WHEN stddev_pop(ret) > 0 THEN skewness(ret) END AS sk, CASE WHEN stddev_pop(ret) > 0 THEN kurtosis(ret) END AS ku, quantile_cont(ret, 0.95) AS hi, quantile_cont(ret, 0.05) AS lo, min(dd) AS mdd FROM x GROUP BY algo_id),
q0 AS (SELECT algo_id, date, ret, o, product(1 + o) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS q FROM x WHERE o IS NOT NULL), q1 AS (SELECT *, q / max(q) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS od FROM q0),
b AS (SELECT algo_id, CASE WHEN count(*) >= 30 AND var_samp(o) > 1e-10 THEN covar_samp(ret, o) / var_samp(o) END AS bu, CASE WHEN count(*) >= 30 AND var_samp(o) > 1e-10 THEN corr(ret, od) END AS bd FROM q1 GROUP BY algo_id),
f AS (SELECT k.algo_id, c.date, p.ret FROM k CROSS JOIN (SELECT DISTINCT date FROM panel) c LEFT JOIN panel p ON p.algo_id = k.algo_id AND p.date = c.date),
r AS (SELECT algo_id, CASE WHEN count(ret) OVER w63 >= 30 THEN avg(ret) OVER w63 / nullif(CASE WHEN stddev_samp(ret) OVER w63 > 1e-12 THEN stddev_samp(ret) OVER w63 END, 0) * {_R} END AS sh, CASE WHEN count(ret) OVER w21 >= 10 THEN stddev_samp(ret) OVER w21 END AS vv FROM f
  WINDOW w63 AS (PARTITION BY algo_id ORDER BY date ROWS 62 PRECEDING), w21 AS (PARTITION BY algo_id ORDER BY date ROWS 20 PRECEDING)),
st AS (SELECT algo_id, 1 / (stddev_samp(sh) + 0.01) AS ss, 1 / (stddev_samp(vv) + 0.01) AS rs FROM r GROUP BY algo_id)
SELECT algo_id, round(y, 6) + 0.0 AS ann_return, round(v, 6) AS ann_vol, round(y / nullif(v, 0), 6) + 0.0 AS sharpe, round(CASE WHEN dv > 0 THEN y / dv ELSE y / nullif(v, 0) END, 6) + 0.0 AS sortino, round(a1, 6) + 0.0 AS autocorr_1, round(CASE WHEN n > 10 THEN a5 END, 6) + 0.0 AS autocorr_5,
  round(sk, 6) + 0.0 AS skewness, round(ku, 6) + 0.0 AS kurtosis, round(least(abs(hi / nullif(lo, 0)), 10), 6) AS tail_ratio, round(mdd, 6) + 0.0 AS max_dd, round(bu, 6) + 0.0 AS beta_universe, round(bd, 6) + 0.0 AS beta_drawdowns, round(ss, 6) AS sharpe_stability, round(rs, 6) AS return_stability
FROM g LEFT JOIN b USING (algo_id) LEFT JOIN st USING (algo_id)""")
def behaviour_features(spark: SparkSession, d: str) -> DataFrame:
    return lc.behaviour(panel(spark, d))


# Trades with their result, closed ones up to a cutoff realised.
_CUT = "DATE '1999-12-31'"
_RESULTS = f"""{NATION_PRICES}, {NATION_TRADES}, t0 AS (SELECT trade_id, algo_id, CAST(day_open - INTERVAL 1 DAY AS DATE) AS day_open, day_close, volume, invested FROM clean WHERE CAST(day_open - INTERVAL 1 DAY AS DATE) <= {_CUT}),
t1 AS (SELECT t.*, p.close AS entry FROM t0 t ASOF LEFT JOIN px p ON p.algo_id = t.algo_id AND p.date <= t.day_open), t2 AS (SELECT t.*, least(t.day_close, {_CUT}) AS at FROM t1 t),
res AS (SELECT t.trade_id, t.algo_id, t.day_open, t.day_close, t.volume, t.day_close <= {_CUT} AS is_realized, p.close / nullif(t.entry, 0) - 1 AS pct, t.invested * (p.close / nullif(t.entry, 0) - 1) AS pnl, CAST(t.at - t.day_open AS INT) AS dur FROM t2 t ASOF LEFT JOIN px p ON p.algo_id = t.algo_id AND p.date <= t.at)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    cutoff, p = F.lit("1999-12-31").cast("date"), nation_prices(spark, d)
    t = nation_trades(spark, d).withColumn("day_open", F.date_sub("day_open", 1)).filter(F.col("day_open") <= cutoff).withColumn("at", F.least("day_close", cutoff))
    t = tp.asof_join(t, p.withColumnRenamed("close", "entry"), ["algo_id"], "day_open", "date", ["entry"])
    t = tp.asof_join(t, p.withColumnRenamed("close", "exit"), ["algo_id"], "at", "date", ["exit"])
    gain = F.col("exit") / F.when(F.col("entry") != 0, F.col("entry")) - 1
    return t.select("trade_id", "algo_id", "day_open", "day_close", "volume", (F.col("day_close") <= cutoff).alias("is_realized"), gain.alias("pnl_pct"), (F.col("invested") * gain).alias("pnl"), F.datediff("at", "day_open").alias("duration_days"))


@query(f"""
WITH {_RESULTS}, days AS (SELECT DISTINCT algo_id, date FROM px),
c AS (SELECT algo_id, day_close AS date, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, sum(pnl) FILTER (pnl > 0) AS won, -sum(pnl) FILTER (pnl < 0) AS lost, sum(dur) AS dur, sum(pct) AS pct, count(pct) AS pcts FROM res WHERE is_realized GROUP BY ALL),
j AS (SELECT d.algo_id, d.date, coalesce(sum(c.n), 0) AS n, sum(wins) AS wins, sum(won) AS won, sum(lost) AS lost, sum(dur) AS dur, sum(pct) AS pct, sum(pcts) AS pcts FROM days d LEFT JOIN c ON c.algo_id = d.algo_id AND c.date > d.date - 63 AND c.date <= d.date GROUP BY ALL),
u AS (SELECT algo_id, day_open AS date, sum(volume) AS v FROM res WHERE NOT is_realized GROUP BY ALL),
l AS (SELECT d.algo_id, d.date, sum(u.v) AS v FROM days d LEFT JOIN u ON u.algo_id = d.algo_id AND u.date <= d.date GROUP BY ALL)
SELECT algo_id, strftime(date, '%Y-%m-%d') AS date, CAST(n AS BIGINT) AS n_trades, round(CASE WHEN n > 0 THEN wins / n END, 6) AS hit_ratio, round(CASE WHEN lost > 0 THEN coalesce(won, 0) / lost END, 6) AS profit_factor, round(dur / nullif(n, 0), 6) AS avg_duration, round(pct / nullif(pcts, 0), 6) + 0.0 AS avg_pnl_pct, round(CASE WHEN n > 0 THEN coalesce(v, 0) ELSE 0 END, 6) AS latent_exposure
FROM j JOIN l USING (algo_id, date)""")
def trade_features_63d(spark: SparkSession, d: str) -> DataFrame:
    return lc.trade_features(_results(spark, d), nation_prices(spark, d))


@query(f"""
WITH {NATION_PRICES}, {NATION_TRADES}, o AS (SELECT algo_id, day_open AS date, sum(volume) AS v FROM clean GROUP BY ALL)
SELECT p.algo_id, strftime(p.date, '%Y-%m-%d') AS date, round(coalesce(sum(o.v), 0), 6) AS turnover FROM (SELECT DISTINCT algo_id, date FROM px) p LEFT JOIN o ON o.algo_id = p.algo_id AND o.date > p.date - 21 AND o.date <= p.date GROUP BY ALL""")
def trade_turnover_21d(spark: SparkSession, d: str) -> DataFrame:
    return lc.trade_turnover(nation_trades(spark, d), nation_prices(spark, d))


@query(f"""
WITH {BARS}, a AS (
  SELECT *, row_number() OVER w AS rn, ln(close / lag(close) OVER w) AS r1, ln(close / lag(close, 5) OVER w) AS r5, ln(close / lag(close, 20) OVER w) AS r20, ln(close / lag(close, 60) OVER w) AS r60, close - lag(close) OVER w AS dl,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY file_id ORDER BY date)
), b AS (
  SELECT *, stddev_samp(r1) OVER (w ROWS 4 PRECEDING) * {_R} AS v5, stddev_samp(r1) OVER (w ROWS 9 PRECEDING) * {_R} AS v10, stddev_samp(r1) OVER (w ROWS 19 PRECEDING) * {_R} AS v20, stddev_samp(r1) OVER (w ROWS 59 PRECEDING) * {_R} AS v60,
    avg(close) OVER (w ROWS 4 PRECEDING) AS a5, avg(close) OVER (w ROWS 9 PRECEDING) AS a10, avg(close) OVER (w ROWS 19 PRECEDING) AS a20, avg(close) OVER (w ROWS 49 PRECEDING) AS a50, stddev_samp(close) OVER (w ROWS 19 PRECEDING) AS sd,
    avg(CASE WHEN dl > 0 THEN dl ELSE 0 END) OVER (w ROWS 13 PRECEDING) AS g, avg(CASE WHEN dl < 0 THEN -dl ELSE 0 END) OVER (w ROWS 13 PRECEDING) AS l, avg(tr) OVER (w ROWS 13 PRECEDING) AS atr, max(close) OVER (w ROWS 251 PRECEDING) AS hi, min(close) OVER (w ROWS 251 PRECEDING) AS lo,
    skewness(r1) OVER (w ROWS 19 PRECEDING) AS sk, stddev_pop(r1) OVER (w ROWS 19 PRECEDING) AS sp
  FROM a WINDOW w AS (PARTITION BY file_id ORDER BY date))
SELECT file_id, strftime(date, '%Y-%m-%d') AS date, round(r1, 6) + 0.0 AS ret_1d, round(r5, 6) + 0.0 AS ret_5d, round(r20, 6) + 0.0 AS ret_20d, round(r60, 6) + 0.0 AS ret_60d, round(CASE WHEN rn > 5 THEN v5 END, 6) AS vol_5d, round(CASE WHEN rn > 10 THEN v10 END, 6) AS vol_10d,
  round(CASE WHEN rn > 20 THEN v20 END, 6) AS vol_20d, round(CASE WHEN rn > 60 THEN v60 END, 6) AS vol_60d, round(CASE WHEN rn > 20 AND v20 > 0 THEN v5 / v20 END, 6) AS vol_ratio_5_20, round(CASE WHEN rn > 60 AND v60 > 0 THEN v10 / v60 END, 6) AS vol_ratio_10_60,
  round(CASE WHEN rn >= 5 THEN (close - a5) / a5 END, 6) + 0.0 AS price_vs_sma_5, round(CASE WHEN rn >= 10 THEN (close - a10) / a10 END, 6) + 0.0 AS price_vs_sma_10, round(CASE WHEN rn >= 20 THEN (close - a20) / a20 END, 6) + 0.0 AS price_vs_sma_20, round(CASE WHEN rn >= 50 THEN (close - a50) / a50 END, 6) + 0.0 AS price_vs_sma_50,
  round(CASE WHEN rn >= 20 THEN (a5 - a20) / close END, 6) + 0.0 AS sma_5_20_cross, round(CASE WHEN rn >= 50 THEN (a20 - a50) / close END, 6) + 0.0 AS sma_20_50_cross, round(CASE WHEN rn >= 14 AND l > 0 THEN 100 - 100 / (1 + g / l) END, 6) AS rsi_14, round(CASE WHEN rn >= 20 AND sd > 0 THEN (close - a20) / (2 * sd) END, 6) + 0.0 AS bb_position,
  round(CASE WHEN rn >= 14 THEN atr / close END, 6) AS atr_14_norm, round((close - hi) / hi, 6) + 0.0 AS drawdown_from_peak, round(CASE WHEN rn >= 60 THEN (close - hi) / close END, 6) + 0.0 AS dist_52w_high, round(CASE WHEN rn >= 60 THEN (close - lo) / close END, 6) + 0.0 AS dist_52w_low, round(CASE WHEN rn > 20 AND sp > 0 THEN sk END, 6) + 0.0 AS skew_20d FROM b""")
def technical_features(spark: SparkSession, d: str) -> DataFrame:
    return lc.technical_features(bars(spark, d))


# Returns over stretches of time: regimes of the market that last at least 15 days.
_STRETCHES = f"""{MARKET}, lab AS (SELECT date, CASE WHEN avg(ret) OVER (ORDER BY date ROWS 20 PRECEDING) > 0 THEN 'up' ELSE 'down' END AS regime FROM market),
isl AS (SELECT *, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY regime ORDER BY date) AS g FROM lab), runs AS (SELECT regime, min(date) AS a, max(date) AS z FROM isl GROUP BY regime, g),
per AS (SELECT *, row_number() OVER (ORDER BY a) AS period_id FROM runs WHERE z - a + 1 >= 15)"""


@query(f"""
WITH {_STRETCHES}
SELECT p.algo_id, per.period_id, per.regime, round(product(1 + p.ret) - 1, 6) + 0.0 AS total_return, round(CASE WHEN stddev_samp(p.ret) > 0 THEN avg(p.ret) / stddev_samp(p.ret) * {_R} ELSE 0 END, 6) + 0.0 AS sharpe, count(*) FILTER (p.ret <> 0) AS n_active_days
FROM panel p JOIN per ON p.date BETWEEN per.a AND per.z GROUP BY ALL""")
def period_performance(spark: SparkSession, d: str) -> DataFrame:
    """Per algorithm and stretch of one market regime (15 calendar days at least): the dates of a stretch go with each return of theirs."""
    from ..operators.features import runs

    w = Window.orderBy("date").rowsBetween(-20, 0)
    lab = market(spark, d).withColumn("regime", F.when(F.avg("ret").over(w) > 0, "up").otherwise("down")).withColumn("_all", F.lit(1))
    per = runs(lab, "_all", "regime").filter(F.datediff("last", "first") + 1 >= 15).withColumn("period_id", F.row_number().over(Window.orderBy("first")).cast("long"))
    days = per.select("period_id", "regime", F.explode(F.sequence("first", "last")).alias("date"))
    x = panel(spark, d).join(days, "date")
    dev = F.stddev_samp("ret")
    return x.groupBy("algo_id", "period_id", "regime").agg((F.product(1 + F.col("ret")) - 1).alias("total_return"), F.when(dev > 0, F.avg("ret") / F.when(dev > 0, dev) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), F.count_if(F.col("ret") != 0).alias("n_active_days"))
