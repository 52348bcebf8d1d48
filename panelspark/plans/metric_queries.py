"""Queries on performance metrics and pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as mx
from ..operators import pairs as pr
from ..operators import panel as px
from ..sources.tables import table
from .base import ENRICHED, FAMILIES, MARKET, NATION_PRICES, PANEL, Registry, families, market, nation_panel, nation_prices, panel

query = Registry()
QUERIES, SQL = query.queries, query.sql

_ANN = "CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(*)) - 1 ELSE -1 END"
_SHARPE = "CASE WHEN abs(stddev_samp(ret)) > 1e-10 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END"


@query(f"""
WITH b AS (
  SELECT event_type, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value > 0 GROUP BY ALL
), panel AS (SELECT event_type, date, close / lag(close) OVER (PARTITION BY event_type ORDER BY date) - 1 AS ret FROM b QUALIFY ret IS NOT NULL),
e0 AS (SELECT *, product(1 + ret) OVER (PARTITION BY event_type ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM panel),
e AS (SELECT *, p / max(p) OVER (PARTITION BY event_type ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e0)
SELECT event_type, count(*) AS n, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS std, round({_SHARPE}, 8) AS sharpe, round(min(dd), 8) AS max_drawdown FROM e GROUP BY event_type""", digits=8)
def algo_profile(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: ticks to daily closes, returns, equity and drawdown, and a profile per type."""
    t = table(spark, d, "events").filter("event_type IS NOT NULL AND ts IS NOT NULL AND value > 0")
    ticks = t.select("event_type", "ts", "event_id", *(F.col("value").alias(c) for c in ("open", "high", "low", "close")))
    r = px.simple_returns(px.daily_bars(ticks, "event_type", tie="event_id"), "event_type").filter("ret IS NOT NULL")
    return mx.summary(px.enrich(r, "event_type"), "event_type").select("event_type", "n", "mean", "std", "sharpe", "max_drawdown")


@query(f"""
WITH {ENRICHED}, s AS (
  SELECT algo_id, count(*) AS n, min(date) AS start, max(date) AS "end", avg(ret) AS mean, stddev_samp(ret) AS std, min(ret) AS min, max(ret) AS max, {_ANN} AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol, {_SHARPE} AS sharpe,
    CASE WHEN count_if(ret < 0) >= 2 THEN avg(ret) / sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(252) ELSE 0 END AS sortino, min(dd) AS max_drawdown, avg(CAST(ret > 0 AS INT)) AS win_rate, skewness(ret) AS skew, kurtosis(ret) AS kurt
  FROM enriched GROUP BY algo_id)
SELECT algo_id, n, start, "end", round(mean, 8) AS mean, round(std, 8) AS std, round(min, 8) AS min, round(max, 8) AS max, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino,
  round(max_drawdown, 6) AS max_drawdown, round(win_rate, 6) AS win_rate, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(CASE WHEN abs(max_drawdown) > 1e-10 THEN ann_return / abs(max_drawdown) ELSE 0 END, 6) AS calmar FROM s""", digits=8)
def full_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = mx.summary(px.enrich(panel(spark, d)))
    six = ["ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "win_rate", "skew", "kurt", "calmar"]
    return s.withColumns({c: F.round(c, 6) for c in six})


@query(f"""
WITH {PANEL}, q AS (SELECT algo_id, quantile_cont(ret, 0.05) AS v, quantile_cont(ret, 0.95) AS hi FROM panel GROUP BY algo_id),
s AS (SELECT p.algo_id, any_value(v) AS v, any_value(hi) AS hi, avg(ret) FILTER (ret <= v) AS c, coalesce(sum(ret) FILTER (ret > 0), 0) AS g, coalesce(sum(-ret) FILTER (ret < 0), 0) AS l FROM panel p JOIN q USING (algo_id) GROUP BY p.algo_id),
t AS (SELECT *, CASE WHEN abs(v) > 1e-10 THEN abs(hi) / abs(v) ELSE 0 END AS tr, CASE WHEN l > 1e-10 THEN g / l WHEN g > 1e-10 THEN 10 ELSE 1 END AS om FROM s)
SELECT algo_id, round(v, 10) AS var, round(c, 10) AS cvar, round(tr, 8) AS tail_ratio, round(om, 8) AS omega, round(tr * om, 8) AS common_sense FROM t""", digits=10)
def var_cvar(spark: SparkSession, d: str) -> DataFrame:
    return mx.tails(panel(spark, d)).withColumns({c: F.round(c, 8) for c in ("tail_ratio", "omega", "common_sense")})


@query(f"""
WITH {PANEL}, x AS (SELECT algo_id, ret, row_number() OVER (PARTITION BY algo_id ORDER BY ret) - 1 AS i, count(*) OVER (PARTITION BY algo_id) AS n FROM panel)
SELECT algo_id, round(max(ret) FILTER (i = CAST(floor(0.05 * n) AS BIGINT)), 10) AS var_index, round(avg(ret) FILTER (i < greatest(CAST(floor(0.05 * n) AS BIGINT), 1)), 10) AS cvar_index FROM x GROUP BY algo_id""", digits=10)
def var_cvar_by_index(spark: SparkSession, d: str) -> DataFrame:
    return mx.tails_by_index(panel(spark, d))


@query(f"""
WITH {PANEL}, a AS (SELECT *, product(1 + ret) OVER w AS p FROM panel WINDOW w AS (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, greatest(max(p) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) AS peak FROM a),
c AS (SELECT *, sum(CASE WHEN p < peak THEN 0 ELSE 1 END) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM b),
r AS (SELECT algo_id, count_if(p < peak) AS len, min(p / peak - 1) AS dd FROM c GROUP BY algo_id, g)
SELECT algo_id, round(min(dd), 8) + 0.0 AS max_drawdown_from_one, CAST(max(len) AS BIGINT) AS longest_below FROM r GROUP BY algo_id""", digits=8)
def drawdown_variants(spark: SparkSession, d: str) -> DataFrame:
    return mx.drawdown_from_one(panel(spark, d))


@query(f"""
WITH {MARKET}, j AS (SELECT p.algo_id, p.ret, m.ret AS b, p.ret - m.ret AS x FROM panel p JOIN market m USING (date)),
s AS (
  SELECT algo_id, covar_samp(ret, b) AS c, var_samp(b) AS v, corr(ret, b) AS corr, stddev_samp(x) * sqrt(252) AS te, count(*) AS n,
    CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(*)) - 1 ELSE -1 END AS r, CASE WHEN product(1 + b) > 0 THEN pow(product(1 + b), 252.0 / count(*)) - 1 ELSE -1 END AS bb,
    CASE WHEN product(1 + x) > 0 THEN pow(product(1 + x), 252.0 / count(*)) - 1 ELSE -1 END AS ex
  FROM j GROUP BY algo_id), t AS (SELECT *, CASE WHEN v > 1e-15 THEN c / v ELSE 0 END AS beta FROM s)
SELECT algo_id, round(beta, 6) + 0.0 AS beta, round(r - beta * bb, 6) + 0.0 AS alpha, round(corr, 6) + 0.0 AS corr, round(te, 6) AS tracking_error, round(CASE WHEN abs(te) > 1e-10 THEN ex / te ELSE 0 END, 6) + 0.0 AS information_ratio, round(ex, 6) + 0.0 AS excess, n FROM t""")
def beta_alpha_ir(spark: SparkSession, d: str) -> DataFrame:
    return mx.against(panel(spark, d), market(spark, d).select("date", F.col("ret").alias("b")))


@query(f"WITH {PANEL} SELECT algo_id, CAST(date_trunc('month', date) AS DATE) AS period, round(product(1 + ret) - 1, 10) + 0.0 AS ret, count(*) AS n FROM panel GROUP BY ALL", digits=10)
def monthly_compound(spark: SparkSession, d: str) -> DataFrame:
    return mx.compounded(panel(spark, d), "MM")


@query(f"""
WITH {PANEL}, m AS (SELECT algo_id, date_trunc('month', date) AS mo, product(1 + ret) - 1 AS r FROM panel GROUP BY ALL)
SELECT algo_id, round(min(r), 10) + 0.0 AS worst_month, round(max(r), 10) + 0.0 AS best_month, round(avg(CAST(r > 0 AS INT)), 8) AS positive_months, count(*) AS n FROM m GROUP BY algo_id""", digits=10)
def month_extremes(spark: SparkSession, d: str) -> DataFrame:
    m = mx.compounded(panel(spark, d), "MM")
    return m.groupBy("algo_id").agg(F.min("ret").alias("worst_month"), F.max("ret").alias("best_month"), F.round(F.avg((F.col("ret") > 0).cast("int")), 8).alias("positive_months"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {MARKET}, w AS (SELECT date, ret, product(1 + greatest(ret, -0.2)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM market),
p AS (SELECT unnest(['week', 'month', 'quarter', 'year']) AS unit), x AS (SELECT unit, date_trunc(unit, date) AS period, arg_max(v, date) AS last FROM w, p GROUP BY ALL),
r AS (SELECT unit, ln(last / lag(last) OVER (PARTITION BY unit ORDER BY period)) AS lr FROM x)
SELECT unit, count(lr) AS n, round(avg(lr), 8) + 0.0 AS mean_log, round(stddev_samp(lr), 8) AS std_log FROM r GROUP BY unit""", digits=8)
def multi_freq(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    m = market(spark, d).withColumn("v", F.product(1 + F.greatest("ret", F.lit(-0.2))).over(w))
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.trunc("date", u).alias("period")) for u in ("week", "month", "quarter", "year")))
    x = m.select("date", "v", F.explode(units).alias("u")).groupBy("u.unit", "u.period").agg(F.max_by("v", "date").alias("last"))
    r = x.withColumn("lr", F.ln(F.col("last") / F.lag("last").over(Window.partitionBy("unit").orderBy("period"))))
    return r.groupBy("unit").agg(F.count("lr").alias("n"), F.avg("lr").alias("mean_log"), F.stddev_samp("lr").alias("std_log"))


@query(f"""
WITH {PANEL}, {FAMILIES}, j AS (SELECT p.date, f.family, p.ret FROM panel p JOIN fam f USING (algo_id))
SELECT date, family, round(avg(ret), 10) + 0.0 AS mean_ret, round(stddev_samp(ret), 10) AS std_ret, count(*) AS n_active FROM j GROUP BY date, family""", digits=10)
def family_aggregates(spark: SparkSession, d: str) -> DataFrame:
    j = panel(spark, d).join(families(spark, d), "algo_id")
    return j.groupBy("date", "family").agg(F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret"), F.count(F.lit(1)).alias("n_active"))


@query(f"""
WITH {PANEL}, s AS (SELECT date, ret, abs(ret) / nullif(sum(abs(ret)) OVER (PARTITION BY date), 0) AS w FROM panel)
SELECT date, round(stddev_samp(ret), 10) AS dispersion, round(avg(CAST(ret > 0 AS INT)), 8) AS pct_positive, round(sum(w * w), 8) AS hhi, round((count_if(ret > 0) - count_if(ret < 0)) * 1.0 / (count_if(ret > 0) + count_if(ret < 0) + 1), 8) + 0.0 AS breadth, count(*) AS n_active FROM s GROUP BY date""", digits=10)
def universe_features(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum(F.abs("ret")).over(Window.partitionBy("date"))
    s = panel(spark, d).withColumn("w", F.abs("ret") / F.when(total > 0, total))
    up, down = F.count_if(F.col("ret") > 0), F.count_if(F.col("ret") < 0)
    eight = lambda c, n: F.round(c, 8).alias(n)
    return s.groupBy("date").agg(F.stddev_samp("ret").alias("dispersion"), eight(F.avg((F.col("ret") > 0).cast("int")), "pct_positive"), eight(F.sum(F.col("w") * F.col("w")), "hhi"), eight((up - down) / (up + down + 1), "breadth"), F.count(F.lit(1)).alias("n_active"))


@query(f"""
WITH {PANEL}, m AS (SELECT algo_id, count(*) AS n, {_SHARPE} AS s, product(1 + ret) - 1 AS t FROM panel GROUP BY algo_id HAVING count(*) >= 30),
r AS (SELECT algo_id, (s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0) AS a, (t - min(t) OVER ()) / nullif(max(t) OVER () - min(t) OVER (), 0) AS b FROM m)
SELECT algo_id, round(0.6 * a + 0.4 * b, 8) AS composite, row_number() OVER (ORDER BY round(0.6 * a + 0.4 * b, 8) DESC, algo_id) AS rank FROM r""", digits=8)
def composite_ranking(spark: SparkSession, d: str) -> DataFrame:
    m = panel(spark, d).groupBy("algo_id").agg(F.count(F.lit(1)).alias("n"), mx.sharpe().alias("s"), (F.product(1 + F.col("ret")) - 1).alias("t")).filter("n >= 30")
    one = Window.partitionBy(F.lit(1))  # one row per algorithm

    def scaled(c):
        lo, hi = F.min(c).over(one), F.max(c).over(one)
        return (F.col(c) - lo) / F.when(hi > lo, hi - lo)

    r = m.withColumn("composite", F.round(0.6 * scaled("s") + 0.4 * scaled("t"), 8))
    return r.select("algo_id", "composite", F.row_number().over(one.orderBy(F.col("composite").desc(), "algo_id")).alias("rank"))


# Pairs are taken among the nations, whose prices share their days.
_NTOP = NATION_PRICES + ", top AS (SELECT algo_id FROM panel GROUP BY algo_id ORDER BY count(*) DESC, algo_id LIMIT 100), pt AS (SELECT p.* FROM panel p JOIN top USING (algo_id))"
_NPAIRS = _NTOP + ", pc AS (SELECT a.algo_id AS a, b.algo_id AS b, corr(a.ret, b.ret) AS corr, count(*) AS n FROM pt a JOIN pt b ON a.date = b.date AND a.algo_id < b.algo_id GROUP BY ALL HAVING count(*) >= 30)"


#: Entities of the queries over all pairs: the reference's caps, 50 for rolling means.
_ALL, _ALL_ROLLING = 100, 50


def _pairs(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    return pr.correlations(nation_panel(spark, d), top=top)


@query(f"WITH {_NPAIRS} SELECT a, b, round(corr, 6) + 0.0 AS corr, n FROM pc")
def corr_matrix_pairs(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    return _pairs(spark, d, top)


@query(f"WITH {_NPAIRS}, s AS (SELECT a, b, corr FROM pc UNION ALL SELECT b, a, corr FROM pc), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(corr, 9), b) AS rank FROM s) SELECT a, b, round(corr, 6) + 0.0 AS corr, rank FROM r WHERE rank <= 5")
def best_diversifiers(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    p = _pairs(spark, d, top).withColumn("corr", F.round("corr", 9))
    return pr.best_diversifiers(p, 5)


@query(f"WITH {_NPAIRS} SELECT a, b, round(corr, 6) + 0.0 AS corr, n FROM pc WHERE abs(corr) < 0.02")
def low_corr_pairs(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    return _pairs(spark, d, top).filter(F.abs("corr") < 0.02)


@query(f"""
WITH {_NPAIRS}, q AS (SELECT a, b, round(corr, 9) AS corr FROM pc), h AS (SELECT * FROM q ORDER BY corr DESC, a, b LIMIT 10), l AS (SELECT * FROM q ORDER BY corr, a, b LIMIT 10), s AS (SELECT * FROM q ORDER BY abs(corr) DESC, a, b LIMIT 10)
SELECT a, b, round(corr, 6) + 0.0 AS corr FROM (SELECT * FROM h UNION SELECT * FROM l UNION SELECT * FROM s)""")
def top_pairs(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    return pr.top_pairs(_pairs(spark, d, top).withColumn("corr", F.round("corr", 9)), 10)


@query(f"""
WITH {_NPAIRS}, q AS (SELECT round(corr, 9) AS c FROM pc), l AS (SELECT min(c) AS lo, max(c) AS hi FROM q)
SELECT CAST(least(floor((c - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM q, l GROUP BY ALL""")
def corr_histogram(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    return pr.histogram(_pairs(spark, d, top).withColumn("corr", F.round("corr", 9)), "corr", 20)


@query(f"WITH {_NPAIRS} SELECT count(*) AS n, round(avg(corr), 8) + 0.0 AS mean, round(quantile_cont(corr, 0.5), 8) + 0.0 AS median, round(stddev_samp(corr), 8) AS std, round(avg(CAST(abs(corr) > 0.05 AS INT)), 8) AS strong FROM pc", digits=8)
def corr_statistics(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    return _pairs(spark, d, top).agg(F.count(F.lit(1)).alias("n"), F.avg("corr").alias("mean"), F.expr("percentile(corr, 0.5)").alias("median"), F.stddev_samp("corr").alias("std"), F.avg((F.abs("corr") > 0.05).cast("int")).alias("strong"))


@query(f"""
WITH {NATION_PRICES}, j AS (SELECT a.date, a.ret AS x, b.ret AS y, row_number() OVER (ORDER BY a.date) AS rn FROM panel a JOIN panel b ON a.date = b.date AND a.algo_id = 'N1' AND b.algo_id = 'N2')
SELECT date, round(corr(x, y) OVER (ORDER BY date ROWS 62 PRECEDING), 6) + 0.0 AS corr FROM j QUALIFY rn >= 63""")
def rolling_corr_pair(spark: SparkSession, d: str) -> DataFrame:
    return pr.rolling_correlation(nation_panel(spark, d), "N1", "N2", 63)


@query(f"""
WITH {NATION_PRICES}, top AS (SELECT algo_id FROM panel GROUP BY algo_id ORDER BY count(*) DESC, algo_id LIMIT 50), pt AS (SELECT p.algo_id, p.date, p.ret FROM panel p JOIN top USING (algo_id)),
dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM pt)), x AS (SELECT pt.*, dt.i FROM pt JOIN dt USING (date)),
pp AS (SELECT a.algo_id AS a, b.algo_id AS b, a.i, a.ret AS x, b.ret AS y FROM x a JOIN x b ON a.i = b.i AND a.algo_id < b.algo_id),
w AS (SELECT dt.date, pp.a, pp.b, corr(pp.x, pp.y) AS c FROM dt JOIN pp ON pp.i BETWEEN dt.i - 41 AND dt.i WHERE dt.i >= 41 GROUP BY ALL HAVING count(*) >= 5)
SELECT date, round(avg(c), 6) + 0.0 AS mean_corr, count(*) AS pairs FROM w GROUP BY date""")
def mean_rolling_corr(spark: SparkSession, d: str, top: int = _ALL_ROLLING) -> DataFrame:
    return pr.mean_correlation(nation_panel(spark, d), top, 42)


@query(f"""
WITH {_NTOP}, v AS (SELECT a.algo_id AS a, b.algo_id AS b, covar_samp(a.ret, b.ret) AS c, var_samp(a.ret) AS va, var_samp(b.ret) AS vb FROM pt a JOIN pt b ON a.date = b.date AND a.algo_id < b.algo_id GROUP BY ALL HAVING count(*) > 1),
o AS (SELECT k, avg(v) AS v FROM (SELECT a AS k, va AS v FROM v UNION ALL SELECT b, vb FROM v) GROUP BY k), s AS (SELECT sum(sqrt(v)) AS sd, sum(v) AS v, count(*) AS n FROM o), c AS (SELECT sum(c) AS c FROM v)
SELECT round(CASE WHEN s.n >= 2 AND s.v + 2 * c.c > 0 THEN s.sd / sqrt(s.v + 2 * c.c) ELSE 1 END, 6) AS ratio, s.n FROM s, c""")
def diversification_ratio(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    return pr.diversification(pr.moments(nation_panel(spark, d), top=top))


@query(f"""
WITH {_NPAIRS}, q AS (SELECT a, b FROM pc ORDER BY round(corr, 9) DESC, a, b LIMIT 20),
j AS (SELECT q.a, q.b, x.date, x.close AS y, z.close AS x FROM q JOIN px x ON x.algo_id = q.a JOIN px z ON z.algo_id = q.b AND z.date = x.date),
f AS (SELECT a, b, covar_samp(y, x) / var_pop(x) AS h, count(*) AS n FROM j GROUP BY ALL HAVING count(*) >= 60), r AS (SELECT j.a, j.b, j.date, f.n, f.h, y - f.h * x AS e FROM j JOIN f ON f.a = j.a AND f.b = j.b),
l AS (SELECT *, lag(e) OVER (PARTITION BY a, b ORDER BY date) AS lg FROM r),
g AS (SELECT a, b, any_value(h) AS h, any_value(n) AS n, regr_slope(e - lg, lg) AS phi, regr_syy(e - lg, lg) AS syy, regr_sxx(e - lg, lg) AS sxx, regr_sxy(e - lg, lg) AS sxy, regr_count(e - lg, lg) AS m, avg(e) AS me, stddev_samp(e) AS se, arg_max(e, date) AS le FROM l GROUP BY ALL)
SELECT a, b, round(h, 6) + 0.0 AS hedge, round(phi / sqrt(greatest(syy - phi * sxy, 0) / (m - 2) / sxx), 5) + 0.0 AS t_stat, round(CASE WHEN phi < 0 THEN least(-ln(2) / phi, 9999) ELSE 9999 END, 6) AS half_life, round((le - me) / se, 6) + 0.0 AS z, n FROM g""")
def cointegration(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    best = _pairs(spark, d, top).orderBy(F.round("corr", 9).desc(), "a", "b").limit(20)
    out = pr.cointegration(nation_prices(spark, d), best)
    return out.withColumn("t_stat", F.round("t_stat", 5))


@query(f"""
WITH {NATION_PRICES}, q AS (SELECT *, CASE WHEN year(date) <= 1997 THEN 'early' ELSE 'late' END AS regime FROM panel), top AS (SELECT algo_id FROM panel GROUP BY algo_id ORDER BY count(*) DESC, algo_id LIMIT 100), t AS (SELECT q.* FROM q JOIN top USING (algo_id))
SELECT a.algo_id AS a, b.algo_id AS b, a.regime, round(corr(a.ret, b.ret), 6) + 0.0 AS corr, count(*) AS n FROM t a JOIN t b ON a.date = b.date AND a.algo_id < b.algo_id GROUP BY ALL HAVING count(*) >= 30""")
def corr_by_regime(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    p = nation_panel(spark, d).withColumn("regime", F.when(F.year("date") <= 1997, "early").otherwise("late"))
    return pr.correlations(p, top=top, by="regime")


@query(f"""
WITH {_NPAIRS}, e AS (SELECT a, b, corr FROM pc WHERE abs(corr) > 0.03), s AS (SELECT a AS node, corr FROM e UNION ALL SELECT b, corr FROM e)
SELECT node, count(*) AS degree, round(sum(abs(corr)), 6) AS strength FROM s GROUP BY node""")
def corr_graph_nodes(spark: SparkSession, d: str, top: int = _ALL) -> DataFrame:
    e = pr.both_directions(_pairs(spark, d, top).filter(F.abs("corr") > 0.03))
    return e.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum(F.abs("corr")).alias("strength"))
