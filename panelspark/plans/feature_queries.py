"""Queries on bars, equity, cumulative, rolling and cross-sectional features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from ..operators import features as fx
from ..operators import panel as px
from ..sources.tables import table
from .base import BARS, ENRICHED, MARKET, PANEL, Registry, bars, market, panel, safe_div

query = Registry()
QUERIES, SQL = query.queries, query.sql

R21 = "(PARTITION BY algo_id ORDER BY date ROWS 20 PRECEDING)"


@query(f"WITH {BARS} SELECT file_id, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n FROM bars")
def ohlc_daily(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d)


@query("""
WITH b AS (
  SELECT event_type, time_bucket(INTERVAL 4 HOUR, ts) AS bin, sum(value) AS total, arg_max(value, (ts, event_id)) AS last, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL
) SELECT event_type, bin, round(total, 6) AS total, round(last, 6) AS last, n FROM b""")
def resample_4h(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type IS NOT NULL")
    e = e.withColumn("order", F.struct("ts", "event_id"))
    out = e.groupBy("event_type", F.window("ts", "4 hours").alias("w")).agg(F.sum("value").alias("total"), F.max_by("value", "order").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select("event_type", F.col("w.start").alias("bin"), "total", "last", "n")


@query(f"""
WITH {BARS}, l AS (SELECT *, lag(close) OVER (PARTITION BY file_id ORDER BY date) AS prev FROM bars)
SELECT file_id, date, round(close, 6) AS close, round(close / prev - 1, 6) + 0.0 AS ret, round(ln(close / prev), 6) + 0.0 AS log_ret FROM l""")
def returns_panel(spark: SparkSession, d: str) -> DataFrame:
    return px.simple_returns(bars(spark, d).select("file_id", "date", "close"), "file_id")


@query(f"WITH {ENRICHED} SELECT algo_id, date, rn, round(p, 6) + 0.0 AS p, round(peak, 6) + 0.0 AS peak, round(dd, 6) + 0.0 AS dd FROM enriched")
def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return px.enrich(panel(spark, d)).select("algo_id", "date", "rn", "p", "peak", "dd")


@query(f"""
WITH {ENRICHED} SELECT algo_id, date, round(p * 100, 6) + 0.0 AS equity FROM enriched
UNION ALL SELECT algo_id, CAST(min(date) - INTERVAL 1 DAY AS DATE), 100.0 FROM panel GROUP BY algo_id""")
def equity_base_100(spark: SparkSession, d: str) -> DataFrame:
    return px.equity_with_base(panel(spark, d), "algo_id")


@query(f"""
WITH {PANEL}, a AS (SELECT *, row_number() OVER (PARTITION BY algo_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY algo_id) AS n FROM panel),
b AS (SELECT *, max(CASE WHEN abs(ret) > 1e-12 THEN rn END) OVER (PARTITION BY algo_id) AS lm FROM a),
c AS (SELECT *, coalesce(n >= 5 AND n - lm > 5 AND (n - lm) * 1.0 / n > 0.10, false) AS was_trimmed FROM b)
SELECT algo_id, count(*) AS n, count_if(NOT was_trimmed OR rn <= lm + 1) AS kept, max(CASE WHEN was_trimmed THEN n - lm ELSE 0 END) AS dead,
  max(CASE WHEN was_trimmed THEN date END) FILTER (rn = lm) AS death_date, bool_or(was_trimmed) AS was_trimmed FROM c GROUP BY algo_id""")
def trim_dead_tail(spark: SparkSession, d: str) -> DataFrame:
    t = px.trim_dead_tail(panel(spark, d), "algo_id")
    death = F.max(F.when(F.col("was_trimmed") & (F.col("rn") == F.col("n") - F.col("dead")), F.col("date")))
    return t.groupBy("algo_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"), F.max("dead").cast("long").alias("dead"), death.alias("death_date"), F.bool_or("was_trimmed").alias("was_trimmed"))


@query(f"""
WITH {ENRICHED}, f AS (
  SELECT algo_id, date, rn, dd, p / nullif(first_value(p) OVER c, 0) - 1 AS cum_return,
    CASE WHEN rn >= 2 THEN stddev_pop(ret) OVER c * sqrt(252) END AS cum_vol, avg(ret) OVER c AS m, stddev_pop(ret) OVER c AS s,
    sum(greatest(ret, 0)) OVER c AS g, sum(greatest(-ret, 0)) OVER c AS l, min(dd) OVER c AS max_drawdown
  FROM enriched WINDOW c AS (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING)
)
SELECT algo_id, date, round(cum_return, 6) + 0.0 AS cum_return, round(cum_vol, 6) + 0.0 AS cum_vol,
  CASE WHEN rn >= 2 THEN CASE WHEN s <= 1e-10 THEN 0.0 ELSE round(m / s * sqrt(252), 6) + 0.0 END END AS cum_sharpe,
  CASE WHEN l > 1e-10 THEN round(g / l, 6) + 0.0 END AS cum_profit_factor, round(max_drawdown, 6) + 0.0 AS max_drawdown,
  CASE WHEN rn >= 21 THEN CASE WHEN abs(max_drawdown) <= 1e-10 THEN 0.0 ELSE round((pow(greatest(cum_return + 1, 0), 252.0 / rn) - 1) / abs(max_drawdown), 4) + 0.0 END END AS cum_calmar
FROM f""")
def feat_cumulative(spark: SparkSession, d: str) -> DataFrame:
    out = fx.cumulative(px.enrich(panel(spark, d)))
    return out.select("algo_id", "date", "cum_return", "cum_vol", "cum_sharpe", "cum_profit_factor", "max_drawdown", F.round("cum_calmar", 4).alias("cum_calmar"))


def _rolling(n: int) -> None:
    sql = f"""
WITH {ENRICHED}, f AS (
  SELECT algo_id, date, rn, p / nullif(lag(p, {n}) OVER o, 0) - 1 AS rr, avg(ret) OVER r AS m, stddev_pop(ret) OVER r AS s,
    sum(greatest(ret, 0)) OVER r AS g, sum(greatest(-ret, 0)) OVER r AS l
  FROM enriched WINDOW o AS (PARTITION BY algo_id ORDER BY date), r AS (PARTITION BY algo_id ORDER BY date ROWS {n - 1} PRECEDING)
)
SELECT algo_id, date, round(rr, 6) + 0.0 AS roll_return, CASE WHEN rn >= {n} THEN round(s * sqrt(252), 6) + 0.0 END AS roll_vol,
  CASE WHEN rn >= {n} THEN CASE WHEN s <= 1e-10 THEN 0.0 ELSE round(m / s * sqrt(252), 6) + 0.0 END END AS roll_sharpe,
  CASE WHEN rn >= {n} AND l > 1e-10 THEN round(g / l, 7) + 0.0 END AS roll_profit_factor FROM f"""

    @query(sql, name=f"feat_rolling_{n}", digits=7)
    def feat(spark: SparkSession, d: str) -> DataFrame:
        out = fx.rolling(px.enrich(panel(spark, d)), n)
        six = [F.round(c, 6).alias(c) for c in ("roll_return", "roll_vol", "roll_sharpe")]
        return out.select("algo_id", "date", *six, "roll_profit_factor")


for _n in (5, 21, 63):
    _rolling(_n)


def _mdd_sql(n: int) -> str:
    return f"""
WITH {ENRICHED}, v AS (SELECT algo_id, date, rn, p, lag(p, {n - 1}) OVER (PARTITION BY algo_id ORDER BY date) AS back FROM enriched),
pairs AS (
  SELECT a.algo_id, a.date, a.rn, b.p, max(b.p) OVER (PARTITION BY a.algo_id, a.date ORDER BY b.rn ROWS UNBOUNDED PRECEDING) AS m
  FROM v a JOIN v b ON a.algo_id = b.algo_id AND b.rn BETWEEN a.rn - {n - 1} AND a.rn WHERE a.rn >= {n}
), w AS (SELECT algo_id, date, min(CASE WHEN m > 0 THEN p / m - 1 ELSE 0 END) AS mdd FROM pairs GROUP BY ALL)
"""


@query(_mdd_sql(21) + """
SELECT v.algo_id, v.date, round(mdd, 6) + 0.0 AS roll_max_drawdown,
  CASE WHEN v.rn >= 21 THEN CASE WHEN abs(mdd) <= 1e-10 THEN 0.0 WHEN back > 0 THEN round((pow(v.p / back, 252.0 / 21) - 1) / abs(mdd), 3) + 0.0 END END AS roll_calmar
FROM v LEFT JOIN w USING (algo_id, date)""")
def feat_rolling_maxdd(spark: SparkSession, d: str) -> DataFrame:
    out = fx.rolling_calmar(px.enrich(panel(spark, d)), 21)
    return out.select("algo_id", "date", "roll_max_drawdown", F.round("roll_calmar", 3).alias("roll_calmar"))


@query(f"""
WITH {ENRICHED}, f AS (SELECT algo_id, date, rn, sum(ret) OVER r AS s, avg(ret) OVER r AS m, var_samp(ret) OVER r AS v, stddev_samp(ret) OVER r AS sd,
  sum(greatest(ret, 0)) OVER r AS g, sum(greatest(-ret, 0)) OVER r AS l FROM enriched WINDOW r AS {R21})
SELECT algo_id, date, CASE WHEN rn >= 21 THEN round(s, 6) + 0.0 END AS roll_sum, CASE WHEN rn >= 21 THEN round(m, 6) + 0.0 END AS roll_mean, CASE WHEN rn >= 21 THEN round(v, 8) + 0.0 END AS roll_var,
  CASE WHEN rn >= 21 THEN CASE WHEN sd <= 1e-10 THEN 0.0 ELSE round(m / sd * sqrt(252), 6) + 0.0 END END AS sharpe_sample,
  CASE WHEN rn >= 21 THEN CASE WHEN l > 1e-10 THEN round(g / l, 7) + 0.0 WHEN g > 1e-10 THEN 10.0 ELSE 1.0 END END AS profit_factor_10_1 FROM f""", digits=8)
def feat_rolling_variants(spark: SparkSession, d: str) -> DataFrame:
    out = fx.rolling_variants(px.enrich(panel(spark, d)), 21)
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("algo_id", "date", r("roll_sum", 6), r("roll_mean", 6), r("roll_var", 8), r("sharpe_sample", 6), r("profit_factor_10_1", 7))


@query(f"""
WITH {ENRICHED}, f AS (SELECT date, CASE WHEN rn >= 21 THEN stddev_samp(ret) OVER r * sqrt(252) END AS v, CASE WHEN rn >= 21 THEN sum(ret) OVER r END AS s FROM enriched WINDOW r AS {R21})
SELECT date, round(avg(v), 10) + 0.0 AS mean_vol, round(avg(s), 10) + 0.0 AS mean_sum, count(v) AS n FROM f GROUP BY date""", digits=10)
def feat_market_regime(spark: SparkSession, d: str) -> DataFrame:
    return fx.market_features(px.enrich(panel(spark, d)), 21)


@query(f"""
WITH {BARS}, a AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS prev FROM bars WINDOW w AS (PARTITION BY file_id ORDER BY date)),
b AS (SELECT *, greatest(close - prev, 0) AS up, greatest(prev - close, 0) AS down, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, close / prev - 1 AS ret FROM a),
f AS (
  SELECT file_id, date, rn, close, avg(close) OVER w20 AS m20, avg(close) OVER w50 AS m50, stddev_samp(close) OVER w20 AS sd,
    avg(CASE WHEN prev IS NOT NULL THEN up END) OVER w14 AS g, avg(CASE WHEN prev IS NOT NULL THEN down END) OVER w14 AS l, avg(tr) OVER w14 AS atr, max(close) OVER w252 AS hi, skewness(ret) OVER w21 AS sk
  FROM b WINDOW w20 AS (PARTITION BY file_id ORDER BY date ROWS 19 PRECEDING), w50 AS (PARTITION BY file_id ORDER BY date ROWS 49 PRECEDING), w14 AS (PARTITION BY file_id ORDER BY date ROWS 13 PRECEDING),
    w252 AS (PARTITION BY file_id ORDER BY date ROWS 251 PRECEDING), w21 AS (PARTITION BY file_id ORDER BY date ROWS 20 PRECEDING)
)
SELECT file_id, date, CASE WHEN rn >= 20 THEN round(m20, 8) END AS sma_20, CASE WHEN rn >= 50 THEN round(m50, 8) END AS sma_50,
  CASE WHEN rn >= 15 THEN CASE WHEN l > 0 THEN round(100 - 100 / (1 + g / l), 7) ELSE 100.0 END END AS rsi_14,
  CASE WHEN rn >= 20 THEN round(m20 + 2 * sd, 7) END AS bb_high, CASE WHEN rn >= 20 THEN round(m20 - 2 * sd, 7) + 0.0 END AS bb_low,
  CASE WHEN rn >= 14 THEN round(atr, 7) END AS atr_14, round(close / hi - 1, 7) + 0.0 AS from_high, CASE WHEN rn >= 22 THEN round(sk, 7) + 0.0 END AS skew_21 FROM f""", digits=8)
def technicals(spark: SparkSession, d: str) -> DataFrame:
    seven = [F.round(c, 7).alias(c) for c in ("rsi_14", "bb_high", "bb_low", "atr_14", "from_high", "skew_21")]
    return fx.technicals(bars(spark, d)).select("file_id", "date", "sma_20", "sma_50", *seven)


@query(f"""
WITH {MARKET}, a AS (
  SELECT date, row_number() OVER (ORDER BY date) AS rn, stddev_samp(ret) OVER w21 * sqrt(252) AS v, avg(ret) OVER w63 * 252 AS m, sum(ret) OVER w21 AS t FROM market
  WINDOW w21 AS (ORDER BY date ROWS 20 PRECEDING), w63 AS (ORDER BY date ROWS 62 PRECEDING)
), b AS (SELECT date, CASE WHEN rn >= 21 THEN v END AS v, CASE WHEN rn >= 63 THEN m END AS m, CASE WHEN rn >= 21 THEN t END AS t FROM a)
SELECT date, round(v, 10) AS vol_21, round(m, 10) + 0.0 AS momentum_63, round(t, 10) + 0.0 AS trend_21, round(v - lag(v, 21) OVER (ORDER BY date), 10) + 0.0 AS vol_change FROM b""", digits=10)
def market_trend(spark: SparkSession, d: str) -> DataFrame:
    return fx.trend_momentum(market(spark, d)).select("date", "vol_21", "momentum_63", "trend_21", "vol_change")


@query(f"""
WITH {MARKET}, m AS (SELECT date, ret FROM market)
SELECT date, round(quantile_cont(ret, 0.25) OVER w, 10) + 0.0 AS q25, round(quantile_cont(ret, 0.5) OVER w, 10) + 0.0 AS q50, round(quantile_cont(ret, 0.75) OVER w, 10) + 0.0 AS q75
FROM m WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""", digits=10)
def expanding_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return fx.expanding_quantiles(market(spark, d), "ret").select("date", "q25", "q50", "q75")


@query(f"""
WITH {PANEL}, l AS (SELECT algo_id, ret, lag(ret) OVER (PARTITION BY algo_id ORDER BY date) AS x FROM panel)
SELECT algo_id, round(corr(ret, x), 6) + 0.0 AS autocorr, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY algo_id""")
def autocorr_lag1(spark: SparkSession, d: str) -> DataFrame:
    return fx.autocorrelation(panel(spark, d), 1)


@query(f"""
WITH {PANEL}, s AS (SELECT algo_id, date, sign(ret) AS s, row_number() OVER (PARTITION BY algo_id ORDER BY date) - row_number() OVER (PARTITION BY algo_id, sign(ret) ORDER BY date) AS g FROM panel),
r AS (SELECT algo_id, s, count(*) AS n FROM s GROUP BY algo_id, s, g)
SELECT algo_id, coalesce(max(n) FILTER (s = 1), 0) AS best_streak, coalesce(max(n) FILTER (s = -1), 0) AS worst_streak FROM r GROUP BY algo_id""")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return fx.streaks(panel(spark, d))


@query(f"WITH {ENRICHED} SELECT algo_id, round(coalesce(min(CASE WHEN dd <= -0.05 THEN rn - 1 END) * 1.0 / count(*), 1.0), 6) AS first_deep_drawdown FROM enriched GROUP BY algo_id")
def first_deep_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return fx.first_deep_drawdown(px.enrich(panel(spark, d)))


@query(f"""
WITH {ENRICHED}, x AS (SELECT *, count(*) OVER (PARTITION BY algo_id) AS n FROM enriched),
y AS (SELECT algo_id, ret, CAST(least((rn - 1) // greatest(n // 3, 1), 2) AS INT) AS part FROM x)
SELECT algo_id, part, round(avg(ret), 8) + 0.0 AS mean_ret, round(stddev_samp(ret), 8) AS vol, round(product(1 + ret) - 1, 8) + 0.0 AS total, count(*) AS n FROM y GROUP BY ALL""", digits=8)
def terciles(spark: SparkSession, d: str) -> DataFrame:
    return fx.terciles(px.enrich(panel(spark, d)))


@query(f"""
WITH {PANEL}, t AS (SELECT *, sum(ret) OVER (PARTITION BY date) AS s, count(*) OVER (PARTITION BY date) AS n FROM panel),
o AS (SELECT algo_id, ret, (s - ret) / (n - 1) AS others FROM t WHERE n > 1)
SELECT algo_id, CASE WHEN var_samp(others) > 1e-15 THEN round(covar_samp(ret, others) / var_samp(others), 6) + 0.0 END AS beta, round(corr(ret, others), 6) + 0.0 AS corr, count(*) AS n FROM o GROUP BY algo_id""")
def leave_one_out_beta(spark: SparkSession, d: str) -> DataFrame:
    return fx.leave_one_out_beta(panel(spark, d))


@query(f"""
WITH {PANEL}, r AS (SELECT algo_id, date, ret, rank() OVER (PARTITION BY date ORDER BY ret) AS k, count(*) OVER (PARTITION BY date, ret) AS t, count(*) OVER (PARTITION BY date) AS n FROM panel)
SELECT algo_id, date, k + (t - 1) / 2.0 AS avg_rank, round((k + (t - 1) / 2.0) / n, 6) AS pct_rank FROM r""")
def rank_cross_section(spark: SparkSession, d: str) -> DataFrame:
    return fx.average_rank(panel(spark, d), "date", "ret").select("algo_id", "date", "avg_rank", "pct_rank")


_DENSE = (
    PANEL
    + """, days AS (SELECT DISTINCT date FROM panel), span AS (SELECT algo_id, min(date) AS a, max(date) AS z FROM panel GROUP BY algo_id),
dense AS (SELECT s.algo_id, days.date, p.ret, p.algo_id IS NOT NULL AS present FROM span s JOIN days ON days.date BETWEEN s.a AND s.z LEFT JOIN panel p ON p.algo_id = s.algo_id AND p.date = days.date)"""
)


@query(f"WITH {_DENSE} SELECT algo_id, date, round(coalesce(ret, 0), 6) + 0.0 AS ret, present FROM dense")
def calendar_densify(spark: SparkSession, d: str) -> DataFrame:
    return px.densify(panel(spark, d), "algo_id", "ret", F.lit(0.0))


@query(f"""
WITH {_DENSE}, x AS (
  SELECT algo_id, date, max(CASE WHEN present THEN date END) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS a,
    min(CASE WHEN present THEN date END) OVER (PARTITION BY algo_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM dense)
SELECT algo_id, date, CAST(date - a AS INT) AS since_last, CAST(z - date AS INT) AS until_next FROM x""")
def activity_gaps(spark: SparkSession, d: str) -> DataFrame:
    return fx.activity_gaps(px.densify(panel(spark, d), "algo_id", "ret")).select("algo_id", "date", "since_last", "until_next")


@query(f"""
WITH {_DENSE} SELECT algo_id, date, coalesce(max(CAST(present AS INT)) OVER (PARTITION BY algo_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 1, true) AS alive FROM dense""")
def alive_mask(spark: SparkSession, d: str) -> DataFrame:
    return fx.alive(px.densify(panel(spark, d), "algo_id", "ret"), 5).select("algo_id", "date", "alive")


@query(f"""
WITH {_DENSE}, x AS (
  SELECT algo_id, date, ret, max(CASE WHEN present THEN date END) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS a,
    min(CASE WHEN present THEN date END) OVER (PARTITION BY algo_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM dense)
SELECT x.algo_id, x.date, round(l.ret, 10) + 0.0 AS ffill, round(r.ret, 10) + 0.0 AS bfill,
  round(CASE WHEN x.a = x.date THEN x.ret ELSE l.ret + (r.ret - l.ret) * (x.date - x.a) / nullif(x.z - x.a, 0) END, 10) + 0.0 AS linear
FROM x LEFT JOIN panel l ON l.algo_id = x.algo_id AND l.date = x.a LEFT JOIN panel r ON r.algo_id = x.algo_id AND r.date = x.z""", digits=10)
def fill_and_interpolate(spark: SparkSession, d: str) -> DataFrame:
    out = fx.filled_and_interpolated(px.densify(panel(spark, d), "algo_id", "ret"), "ret")
    return out.select("algo_id", "date", "ffill", "bfill", "linear")


@query(f"""
WITH {MARKET}, m AS (SELECT date, row_number() OVER (ORDER BY date) AS i, CASE WHEN ret > 0.001 THEN 'up' WHEN ret < -0.001 THEN 'down' ELSE 'flat' END AS s FROM market),
c AS (SELECT a.date, b.s, count(*) AS n, min(b.i) AS f FROM m a JOIN m b ON b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.date, b.s)
SELECT date, arg_max(s, (n, -f)) AS smoothed FROM c GROUP BY date""")
def regime_smoothed(spark: SparkSession, d: str) -> DataFrame:
    m = market(spark, d).withColumn("s", F.when(F.col("ret") > 0.001, "up").when(F.col("ret") < -0.001, "down").otherwise("flat"))
    return fx.centred_mode(m, "s").select("date", "smoothed")


@query(f"""
WITH {MARKET}, j AS (SELECT p.algo_id, p.date, p.ret AS a, m.ret AS b, row_number() OVER w AS rn FROM panel p JOIN market m USING (date) WINDOW w AS (PARTITION BY p.algo_id ORDER BY p.date)),
f AS (SELECT algo_id, date, rn, corr(a, b) OVER r AS c, stddev_samp(a - b) OVER r * sqrt(252) AS te, covar_samp(a, b) OVER r / nullif(var_samp(b) OVER r, 0) AS beta FROM j WINDOW r AS (PARTITION BY algo_id ORDER BY date ROWS 29 PRECEDING))
SELECT algo_id, date, round(c, 5) + 0.0 AS roll_corr, round(te, 5) AS roll_te, round(beta, 5) + 0.0 AS roll_beta FROM f WHERE rn >= 30""", digits=5)
def rolling_vs_market(spark: SparkSession, d: str) -> DataFrame:
    j = panel(spark, d).join(market(spark, d).select("date", F.col("ret").alias("b")), "date")
    w = px.by("algo_id")
    r = px.last_rows(w, 30)
    out = j.withColumn("rn", F.row_number().over(w)).withColumn("roll_corr", corr("ret", "b", r))
    out = out.withColumn("roll_te", F.stddev_samp(F.col("ret") - F.col("b")).over(r) * F.sqrt(F.lit(252.0)))
    out = out.withColumn("roll_beta", safe_div(F.covar_samp("ret", "b").over(r), F.var_samp("b").over(r)))
    return out.filter("rn >= 30").select("algo_id", "date", "roll_corr", "roll_te", "roll_beta")


@query(f"""
WITH {PANEL}, q AS (SELECT algo_id, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM panel GROUP BY algo_id),
w AS (SELECT p.algo_id, p.date, greatest(least(p.ret, q.hi), q.lo) AS r FROM panel p JOIN q USING (algo_id)),
s AS (SELECT *, min(r) OVER (PARTITION BY algo_id) AS a, max(r) OVER (PARTITION BY algo_id) AS z FROM w)
SELECT algo_id, date, round(r, 6) + 0.0 AS winsorized, round((r - a) / nullif(z - a, 0), 6) + 0.0 AS scaled FROM s""")
def winsorize_scale(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    q = p.groupBy("algo_id").agg(F.expr("percentile(ret, 0.01)").alias("lo"), F.expr("percentile(ret, 0.99)").alias("hi"))
    w = p.join(q, "algo_id").withColumn("winsorized", F.greatest(F.least("ret", "hi"), F.col("lo")))
    part = Window.partitionBy("algo_id")
    low, high = F.min("winsorized").over(part), F.max("winsorized").over(part)
    return w.withColumn("scaled", safe_div(F.col("winsorized") - low, high - low)).select("algo_id", "date", "winsorized", "scaled")


@query(f"""
WITH {ENRICHED}, x AS (SELECT algo_id, date, rn, stddev_samp(ret) OVER w AS s, p, count(*) OVER w AS n FROM enriched WINDOW w AS (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT algo_id, date FROM x WHERE n >= 60 AND s >= 1e-8 AND p > 1""")
def activity_filter(spark: SparkSession, d: str) -> DataFrame:
    e = px.enrich(panel(spark, d))
    c = px.so_far(px.by("algo_id"))
    out = e.withColumn("s", F.stddev_samp("ret").over(c)).withColumn("n", F.count(F.lit(1)).over(c))
    return out.filter("n >= 60 AND s >= 1e-8 AND p > 1").select("algo_id", "date")


@query(f"""
WITH {_DENSE}, x AS (SELECT algo_id, date, sum(CAST(present AS INT)) OVER (PARTITION BY algo_id ORDER BY date ROWS 62 PRECEDING) AS n FROM dense)
SELECT algo_id, date, n >= 40 AS eligible FROM x""")
def universe_eligibility(spark: SparkSession, d: str) -> DataFrame:
    x = px.densify(panel(spark, d), "algo_id", "ret")
    n = F.sum(F.col("present").cast("int")).over(px.last_rows(px.by("algo_id"), 63))
    return x.withColumn("eligible", n >= 40).select("algo_id", "date", "eligible")


@query(f"""
WITH {PANEL}, a AS (SELECT date, algo_id, avg(ret) OVER w AS cur, row_number() OVER (PARTITION BY algo_id ORDER BY date) AS rn FROM panel WINDOW w AS (PARTITION BY algo_id ORDER BY date ROWS 20 PRECEDING)),
b AS (SELECT date, algo_id, cur, lag(cur, 21) OVER (PARTITION BY algo_id ORDER BY date) AS prev, rn FROM a),
r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY round(cur, 12) DESC) AS rc, rank() OVER (PARTITION BY date ORDER BY round(prev, 12) DESC) AS rp FROM b WHERE rn >= 42)
SELECT date, round(1 - corr(rc, rp), 6) + 0.0 AS rotation, count(*) AS n FROM r GROUP BY date HAVING count(*) >= 5""")
def leadership_rotation(spark: SparkSession, d: str) -> DataFrame:
    w = px.by("algo_id")
    a = panel(spark, d).withColumn("cur", F.avg("ret").over(px.last_rows(w, 21))).withColumn("rn", F.row_number().over(w))
    b = a.withColumn("prev", F.lag("cur", 21).over(w)).filter("rn >= 42")
    rank = lambda c: F.rank().over(Window.partitionBy("date").orderBy(F.round(c, 12).desc()))
    r = b.withColumn("rc", rank("cur")).withColumn("rp", rank("prev"))
    return r.groupBy("date").agg((1 - corr("rc", "rp")).alias("rotation"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
