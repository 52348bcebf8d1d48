"""Queries on regimes, selection, allocation, backtests, labels and sets, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import allocate as al
from ..operators import backtest as bt
from ..operators import panel as px
from ..operators import regimes as rg
from ..operators import temporal as tp
from ..sources.tables import with_single
from .base import FAMILIES, MARKET, NATION_PRICES, PANEL, Registry, families, market, nation_panel, panel

query = Registry()
QUERIES, SQL = query.queries, query.sql

_HEURISTIC = (
    MARKET
    + """, ra AS (
  SELECT date, row_number() OVER (ORDER BY date) AS rn, stddev_samp(ret) OVER (ORDER BY date ROWS 20 PRECEDING) * sqrt(252) AS v0, avg(ret) OVER (ORDER BY date ROWS 62 PRECEDING) * 252 AS t0 FROM market
), rb AS (SELECT date, CASE WHEN rn >= 21 THEN v0 END AS v, CASE WHEN rn >= 63 THEN t0 END AS t FROM ra), rc AS (SELECT *, quantile_cont(v, 0.5) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS q FROM rb),
regimes AS (SELECT date, CASE WHEN coalesce(t > 0, false) THEN CASE WHEN coalesce(v > q, false) THEN 'slowdown' ELSE 'expansion' END ELSE CASE WHEN coalesce(v > q, false) THEN 'recession' ELSE 'recovery' END END AS regime FROM rc)"""
)


def heuristic(spark: SparkSession, d: str) -> DataFrame:
    return rg.heuristic(market(spark, d).select("date", "ret"))


@query(f"WITH {_HEURISTIC} SELECT date, regime FROM regimes")
def regime_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return heuristic(spark, d)


@query(f"""
WITH {MARKET}, ra AS (
  SELECT date, row_number() OVER o AS rn, stddev_samp(ret) OVER (o ROWS 20 PRECEDING) * sqrt(252) AS v0, avg(ret) OVER (o ROWS 62 PRECEDING) * 252 AS t0, avg(ret) OVER (o ROWS 20 PRECEDING) * 252 AS s0 FROM market WINDOW o AS (ORDER BY date)
), rb AS (SELECT date, CASE WHEN rn >= 21 THEN v0 END AS v, CASE WHEN rn >= 63 THEN t0 END AS t, CASE WHEN rn >= 63 THEN s0 - t0 END AS m FROM ra),
rq AS (SELECT *, coalesce(v - lag(v, 21) OVER (ORDER BY date), 0) AS dv, coalesce(m, 0) AS mm,
  quantile_cont(t, 0.25) OVER w AS t1, quantile_cont(t, 0.75) OVER w AS t3, quantile_cont(v, 0.25) OVER w AS v1, quantile_cont(v, 0.75) OVER w AS v3, quantile_cont(m, 0.25) OVER w AS m1, quantile_cont(m, 0.75) OVER w AS m3
  FROM rb WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
rf AS (SELECT date, t, v,
  CASE WHEN t >= t3 THEN 1.0 WHEN t <= t1 THEN 0.0 ELSE (t - t1) / (t3 - t1) END AS th, CASE WHEN t <= t1 THEN 1.0 WHEN t >= t3 THEN 0.0 ELSE (t3 - t) / (t3 - t1) END AS tl,
  CASE WHEN v >= v3 THEN 1.0 WHEN v <= v1 THEN 0.0 ELSE (v - v1) / (v3 - v1) END AS vh, CASE WHEN v <= v1 THEN 1.0 WHEN v >= v3 THEN 0.0 ELSE (v3 - v) / (v3 - v1) END AS vl,
  CASE WHEN mm >= m3 THEN 1.0 WHEN mm <= m1 THEN 0.0 ELSE (mm - m1) / (m3 - m1) END AS mh, CASE WHEN mm <= m1 THEN 1.0 WHEN mm >= m3 THEN 0.0 ELSE (m3 - mm) / (m3 - m1) END AS ml,
  CASE WHEN dv > 0.001 THEN 1.0 WHEN dv > -0.001 THEN 0.5 ELSE 0.0 END AS up, CASE WHEN dv < -0.001 THEN 1.0 WHEN dv < 0.001 THEN 0.5 ELSE 0.0 END AS dn FROM rq),
sc AS (SELECT date, t, v, round(least(th, vl, greatest(mh, 0.5)), 9) AS a, round(greatest(least(th, greatest(vh, up * 0.7), ml), least(th * 0.8, vh, up)), 9) AS b, round(least(tl, vh), 9) AS c, round(greatest(least(greatest(tl * 0.5, 0.3), vl, mh), least(tl, dn, mh)), 9) AS e FROM rf)
SELECT date, CASE WHEN t IS NULL OR v IS NULL THEN 'unknown' WHEN a >= greatest(b, c, e) THEN 'expansion' WHEN b >= greatest(c, e) THEN 'slowdown' WHEN c >= e THEN 'recession' ELSE 'recovery' END AS regime FROM sc""")
def regime_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return rg.fuzzy(market(spark, d).select("date", "ret"))


@query(f"""
WITH {_HEURISTIC}, l AS (SELECT regime, lead(regime) OVER (ORDER BY date) AS nx FROM regimes), c AS (SELECT regime AS "from", nx AS "to", count(*) AS n FROM l WHERE nx IS NOT NULL GROUP BY ALL)
SELECT "from", "to", n, round(n / sum(n) OVER (PARTITION BY "from"), 8) AS p FROM c""", digits=8)
def regime_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rg.transitions(heuristic(spark, d), "regime")


_RUNS = _HEURISTIC + ", rr AS (SELECT date, regime, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY regime ORDER BY date) AS g FROM regimes), runs AS (SELECT regime, min(date) AS first, max(date) AS last, count(*) AS len FROM rr GROUP BY regime, g)"


@query(f"WITH {_RUNS} SELECT regime, count(*) AS n_runs, round(avg(len), 8) AS mean_length, max(len) AS longest FROM runs GROUP BY regime", digits=8)
def regime_durations(spark: SparkSession, d: str) -> DataFrame:
    return rg.durations(heuristic(spark, d), "regime")


@query(f"WITH {_RUNS}, k AS (SELECT *, CAST(last - first AS INT) + 1 AS days FROM runs) SELECT row_number() OVER (ORDER BY first) AS period, regime, first, last, days FROM k WHERE days >= 15")
def regime_periods(spark: SparkSession, d: str) -> DataFrame:
    return rg.periods(heuristic(spark, d), "regime", 15)


@query(f"""
WITH {_HEURISTIC}, j AS (SELECT p.algo_id, r.regime, p.ret FROM panel p JOIN regimes r USING (date))
SELECT algo_id, regime, count(*) AS n, round(avg(ret), 10) + 0.0 AS mean_ret, round(CASE WHEN stddev_samp(ret) > 1e-10 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6) + 0.0 AS sharpe FROM j GROUP BY ALL HAVING count(*) > 10""", digits=10)
def perf_by_regime(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import metrics as mx

    j = panel(spark, d).join(heuristic(spark, d), "date")
    return j.groupBy("algo_id", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"), F.round(mx.sharpe(), 6).alias("sharpe")).filter("n > 10")


@query(f"""
WITH {_HEURISTIC}, j AS (SELECT p.algo_id, r.regime, avg(p.ret) * 252 AS m FROM panel p JOIN regimes r USING (date) GROUP BY ALL HAVING count(*) > 10), o AS (SELECT algo_id, avg(m) AS a FROM j GROUP BY algo_id)
SELECT j.algo_id, arg_max(j.regime, (round(j.m, 9), j.regime)) AS best_regime, round(max(j.m) - any_value(o.a), 8) + 0.0 AS regime_alpha, count(*) AS regimes FROM j JOIN o USING (algo_id) GROUP BY j.algo_id""", digits=8)
def regime_specialists(spark: SparkSession, d: str) -> DataFrame:
    j = panel(spark, d).join(heuristic(spark, d), "date").groupBy("algo_id", "regime").agg((F.avg("ret") * 252).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 10")
    return j.groupBy("algo_id").agg(F.max_by("regime", F.struct(F.round("m", 9), "regime")).alias("best_regime"), (F.max("m") - F.avg("m")).alias("regime_alpha"), F.count(F.lit(1)).alias("regimes"))


@query(f"""
WITH {_HEURISTIC}, x AS (SELECT date_trunc('month', date) AS mo, date, regime, lag(regime) OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS pv FROM regimes),
c AS (SELECT mo, regime, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT mo, arg_min(regime, (-n, regime)) AS dominant FROM c GROUP BY mo)
SELECT CAST(x.mo AS DATE) AS month, any_value(k.dominant) AS dominant, count(*) AS n, coalesce(count_if(pv <> regime), 0) AS transitions, round(avg(CAST(regime = 'expansion' AS INT)), 8) AS expansion FROM x JOIN k ON k.mo = x.mo GROUP BY x.mo""", digits=8)
def monthly_regimes(spark: SparkSession, d: str) -> DataFrame:
    r = heuristic(spark, d).withColumn("month", F.trunc("date", "MM"))
    prev = F.lag("regime").over(Window.partitionBy("month").orderBy("date"))
    x = r.withColumn("moved", F.coalesce(prev != F.col("regime"), F.lit(False)))
    return x.groupBy("month").agg(F.expr("mode(regime, true)").alias("dominant"), F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("transitions"), F.avg((F.col("regime") == "expansion").cast("int")).alias("expansion"))


# Selection and allocation work on factors at the month's first date: trailing Sharpe and volatility of 42 rows.
_FACTORS = (
    NATION_PRICES
    + """, fa AS (SELECT algo_id, date, ret, row_number() OVER w AS rn, avg(ret) OVER r AS m, stddev_samp(ret) OVER r AS sd FROM panel WINDOW w AS (PARTITION BY algo_id ORDER BY date), r AS (PARTITION BY algo_id ORDER BY date ROWS 41 PRECEDING)),
sched AS (SELECT min(date) AS date FROM panel GROUP BY date_trunc('month', date)), f AS (SELECT fa.algo_id, fa.date, m, sd, m / sd AS sh FROM fa JOIN sched USING (date) WHERE rn >= 42 AND sd > 1e-8),
z AS (SELECT *, round((coalesce((sh - avg(sh) OVER g) / nullif(stddev_pop(sh) OVER g, 0), 0) - coalesce((sd - avg(sd) OVER g) / nullif(stddev_pop(sd) OVER g, 0), 0))
  / greatest(CAST(stddev_pop(sh) OVER g > 1e-8 AS INT) + CAST(stddev_pop(sd) OVER g > 1e-8 AS INT), 1), 9) + 0.0 AS score FROM f WINDOW g AS (PARTITION BY date)),
sel AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, algo_id) <= 5)"""
)


def factors(spark: SparkSession, d: str) -> DataFrame:
    p = nation_panel(spark, d)
    w = px.by("algo_id")
    r = px.last_rows(w, 42)
    x = p.withColumn("rn", F.row_number().over(w)).withColumn("m", F.avg("ret").over(r)).withColumn("sd", F.stddev_samp("ret").over(r))
    sched = p.groupBy(F.trunc("date", "MM")).agg(F.min("date").alias("date")).select("date")
    f = x.join(sched, "date", "left_semi").filter("rn >= 42 AND sd > 1e-8").withColumn("sh", F.col("m") / F.col("sd"))
    return al.zscores(f.select("algo_id", "date", "m", "sd", "sh"), {"sh": 1, "sd": -1}).withColumn("score", F.round("score", 9) + F.lit(0.0))


def selected(spark: SparkSession, d: str) -> DataFrame:
    return al.top_n(factors(spark, d), "score", 5)


@query(f"WITH {_FACTORS} SELECT date, algo_id, round(score, 6) + 0.0 AS score FROM z")
def factor_zscore(spark: SparkSession, d: str) -> DataFrame:
    return factors(spark, d).select("date", "algo_id", "score")


@query(f"WITH {_FACTORS} SELECT date, algo_id FROM sel")
def select_topn(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d).select("date", "algo_id")


@query(f"""
WITH {_FACTORS}, q AS (SELECT date, quantile_cont(score, 0.8) AS hi, quantile_cont(score, 0.2) AS lo FROM z GROUP BY date)
SELECT z.date, z.algo_id, CASE WHEN score >= hi THEN 1 ELSE -1 END AS side FROM z JOIN q USING (date) WHERE score >= hi OR score <= lo""")
def select_percentile(spark: SparkSession, d: str) -> DataFrame:
    return al.top_share(factors(spark, d), "score", 0.2, side="both").select("date", "algo_id", "side")


@query(f"WITH {_FACTORS} SELECT date, algo_id, round(1.0 / count(*) OVER (PARTITION BY date), 8) AS w FROM sel", digits=8)
def alloc_equal(spark: SparkSession, d: str) -> DataFrame:
    return al.equal(selected(spark, d)).select("date", "algo_id", "w")


@query(f"WITH {_FACTORS} SELECT date, algo_id, round((1 / sd) / sum(1 / sd) OVER (PARTITION BY date), 8) AS w FROM sel", digits=8)
def alloc_invvol(spark: SparkSession, d: str) -> DataFrame:
    return al.inverse_vol(selected(spark, d), "sd").select("date", "algo_id", "w")


@query(f"WITH {_FACTORS} SELECT date, algo_id, round(coalesce(greatest(m, 0) / nullif(sum(greatest(m, 0)) OVER (PARTITION BY date), 0), 1.0 / count(*) OVER (PARTITION BY date)), 8) AS w FROM sel", digits=8)
def alloc_momentum(spark: SparkSession, d: str) -> DataFrame:
    return al.momentum(selected(spark, d), "m").select("date", "algo_id", "w")


_STEP = (
    _FACTORS
    + """, tw AS (SELECT date, algo_id, (1 / sd) / sum(1 / sd) OVER (PARTITION BY date) AS w, 1.0 / count(*) OVER (PARTITION BY date) AS current FROM sel),
c1 AS (SELECT *, greatest(greatest(least(w, 0.3), 0.05), 0) AS c FROM tw), c2 AS (SELECT *, CASE WHEN sum(c) OVER (PARTITION BY date) > 0.95 THEN c * 0.95 / sum(c) OVER (PARTITION BY date) ELSE c END AS e FROM c1),
c3 AS (SELECT *, sum(abs(e - current)) OVER (PARTITION BY date) / 2 AS t FROM c2), c4 AS (SELECT date, algo_id, current, CASE WHEN t > 0.05 THEN current + 0.05 / t * (e - current) ELSE e END AS w FROM c3)"""
)


def _stepped(spark: SparkSession, d: str) -> DataFrame:
    x = al.equal(selected(spark, d)).withColumnRenamed("w", "current")
    return al.constrained(al.inverse_vol(x, "sd"), 0.05, 0.3, 0.95, 0.05)


@query(f"WITH {_STEP} SELECT date, algo_id, round(w, 8) AS w FROM c4", digits=8)
def constraints_step(spark: SparkSession, d: str) -> DataFrame:
    return _stepped(spark, d).select("date", "algo_id", "w")


@query(f"""
WITH {_STEP}, dd AS (SELECT date, abs(w - current) AS a, CASE WHEN abs(w - current) > 1e-6 THEN abs(w - current) END AS x FROM c4)
SELECT date, count(x) AS n_trades, round(sum(a) / 2, 8) AS turnover, round(coalesce(sum(x * 0.0015 + x * x * 0.1), 0) + count(x) * 0.00001, 8) AS cost FROM dd GROUP BY date""", digits=8)
def cost_model(spark: SparkSession, d: str) -> DataFrame:
    return al.costs(_stepped(spark, d).withColumn("dw", F.col("w") - F.col("current")), 0.001, 0.0005, 0.1, 0.00001)


def _backtest(name: str, op: str, same_day: bool) -> None:
    sql = f"""
WITH {_FACTORS}, wt AS (SELECT date, algo_id, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM sel), sd AS (SELECT DISTINCT date FROM wt),
dy AS (SELECT d.date, max(sd.date) AS since FROM (SELECT DISTINCT date FROM panel) d JOIN sd ON sd.date {op} d.date GROUP BY d.date)
SELECT dy.date, round(coalesce(sum(wt.w * p.ret), 0), 8) + 0.0 AS ret, count(p.ret) AS n FROM dy LEFT JOIN wt ON wt.date = dy.since LEFT JOIN panel p ON p.date = dy.date AND p.algo_id = wt.algo_id GROUP BY dy.date"""

    @query(sql, name=name, digits=8)
    def backtest(spark: SparkSession, d: str) -> DataFrame:
        w = al.equal(selected(spark, d)).select("date", "algo_id", "w")
        return bt.run(w, nation_panel(spark, d).select("date", "algo_id", "ret"), same_day)


_backtest("backtest_next_day", "<", False)
_backtest("backtest_same_day", "<=", True)


def _folds(name: str, expanding: bool) -> None:
    start = "0" if expanding else "k * 126"
    sql = f"""
WITH {NATION_PRICES}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)), n AS (SELECT count(*) AS n FROM c),
k AS (SELECT unnest(generate_series(0, (n - 504 - 126) // 126)) AS k FROM n WHERE n >= 630)
SELECT CAST(k AS INT) AS fold_id, a.date AS train_start, b.date AS train_end, e.date AS test_start, g.date AS test_end FROM k JOIN c a ON a.i = {start} JOIN c b ON b.i = k * 126 + 503 JOIN c e ON e.i = k * 126 + 504 JOIN c g ON g.i = k * 126 + 629"""

    @query(sql, name=name)
    def folds(spark: SparkSession, d: str) -> DataFrame:
        return bt.folds(nation_panel(spark, d), 504, 126, 126, expanding)


_folds("walk_forward_folds", False)
_folds("walk_forward_expanding", True)


@query(f"""
WITH {_FACTORS}, wt AS (SELECT date, algo_id, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM sel), sd AS (SELECT DISTINCT date FROM wt), dy AS (SELECT d.date, max(sd.date) AS since FROM (SELECT DISTINCT date FROM panel) d JOIN sd ON sd.date < d.date GROUP BY d.date),
rt AS (SELECT dy.date, coalesce(sum(wt.w * p.ret), 0) AS ret FROM dy LEFT JOIN wt ON wt.date = dy.since LEFT JOIN panel p ON p.date = dy.date AND p.algo_id = wt.algo_id GROUP BY dy.date),
c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)), k AS (SELECT unnest(generate_series(0, ((SELECT count(*) FROM c) - 630) // 126)) AS k),
fs AS (SELECT k, avg(ret) AS m, stddev_samp(ret) AS s FROM k JOIN c ON c.i BETWEEN k * 126 + 504 AND k * 126 + 629 JOIN rt ON rt.date = c.date GROUP BY k), sh AS (SELECT CASE WHEN s > 1e-10 THEN m / s * sqrt(252) ELSE 0 END AS x FROM fs)
SELECT count(*) AS folds, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max FROM sh""")
def fold_aggregate(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import metrics as mx

    w = al.equal(selected(spark, d)).select("date", "algo_id", "w")
    p = nation_panel(spark, d)
    r = bt.run(w, p.select("date", "algo_id", "ret"))
    f = bt.folds(p, 504, 126, 126)  # a row per fold
    j = r.join(F.broadcast(f), (F.col("date") >= F.col("test_start")) & (F.col("date") <= F.col("test_end")))
    s = j.groupBy("fold_id").agg(mx.sharpe().alias("x"))
    return s.agg(F.count(F.lit(1)).alias("folds"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


@query(f"""
WITH {_FACTORS}, wt AS (SELECT date, algo_id, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM sel), dn AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM wt)),
x AS (SELECT wt.*, dn.nx, lag(w) OVER o AS pw, lag(dn.nx) OVER o AS pn FROM wt JOIN dn USING (date) WINDOW o AS (PARTITION BY algo_id ORDER BY date)),
g AS (SELECT *, sum(CASE WHEN pw IS NULL OR abs(w - pw) > 1e-6 OR pn <> date THEN 1 ELSE 0 END) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT algo_id, min(date) AS period_start, CAST(arg_max_null(nx, date) - INTERVAL 1 DAY AS DATE) AS period_end, round(arg_min(w, date), 8) AS w FROM g GROUP BY algo_id, g""", digits=8)
def audit_periods(spark: SparkSession, d: str) -> DataFrame:
    return bt.allocation_periods(al.equal(selected(spark, d)).select("date", "algo_id", "w"))


_SPLITS = "(VALUES ('train', DATE '1996-01-01', DATE '1998-12-31'), ('val', DATE '1999-01-01', DATE '1999-12-31'), ('test', DATE '2000-01-01', DATE '2000-12-31')) AS s(split, a, z)"


@query(f"""
WITH {NATION_PRICES}, sched AS (SELECT min(date) AS date FROM panel GROUP BY date_trunc('month', date)), p AS (SELECT date AS period_start, coalesce(CAST(lead(date) OVER (ORDER BY date) - INTERVAL 1 DAY AS DATE), date) AS period_end FROM sched)
SELECT p.period_start, p.period_end, coalesce(s.split, 'unspecified') AS split FROM p LEFT JOIN {_SPLITS} ON greatest(p.period_start, s.a) <= least(p.period_end, s.z)""")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = nation_panel(spark, d)
    sched = p.groupBy(F.trunc("date", "MM")).agg(F.min("date").alias("date")).select("date")
    periods = bt.periods_of(sched).withColumn("period_end", F.coalesce("period_end", "period_start"))
    splits = spark.sql("SELECT * FROM VALUES ('train', DATE '1996-01-01', DATE '1998-12-31'), ('val', DATE '1999-01-01', DATE '1999-12-31'), ('test', DATE '2000-01-01', DATE '2000-12-31') AS s(split, a, z)")
    return tp.overlapping(periods, splits, "period_start", "period_end", "a", "z", "split", "unspecified")


@query(f"""
WITH {MARKET}, r AS (SELECT date, ret, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM market), s AS (SELECT *, CASE WHEN rn <= floor(0.6 * n) THEN 'train' WHEN rn <= floor(0.8 * n) THEN 'val' ELSE 'test' END AS split FROM r)
SELECT split, count(*) AS n, min(date) AS first, max(date) AS last, round(avg(ret), 10) + 0.0 AS mean_ret FROM s GROUP BY split""", digits=10)
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    r = market(spark, d).withColumn("rn", F.row_number().over(Window.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    split = F.when(F.col("rn") <= F.floor(0.6 * F.col("n")), "train").when(F.col("rn") <= F.floor(0.8 * F.col("n")), "val").otherwise("test")
    return r.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("ret").alias("mean_ret"))


def _gram(m: np.ndarray) -> np.ndarray:
    return np.cov(m, rowvar=False, ddof=1).reshape(m.shape[1], m.shape[1])


def _optimized(name: str, optimize) -> None:
    @query(name=name)
    def allocation(spark: SparkSession, d: str) -> DataFrame:
        """Weights at each month's first date from the last 63 dates, over algorithms with a return on each."""
        p = nation_panel(spark, d)
        sched = p.groupBy(F.trunc("date", "MM")).agg(F.min("date").alias("date")).select("date")
        dense = px.densify(p, "algo_id", "ret", F.lit(0.0)).select("algo_id", "date", "ret")
        return bt.allocate(dense, sched, 63, optimize)


_optimized("alloc_min_variance", lambda m: al.capped_minimum_variance(_gram(m), 0.3))
_optimized("alloc_equal_risk", lambda m: al.equal_risk(_gram(m)))
_optimized("alloc_max_sharpe", lambda m: al.max_sharpe(m.mean(axis=0), _gram(m), 0.3))


# Weekly labels: the tercile of the week's compounded return among all algorithms of the week.
_WEEKLY = (
    PANEL
    + """, wk AS (SELECT algo_id, CAST(date_trunc('week', date + 2) AS DATE) + 4 AS week_end, product(1 + ret) - 1 AS r, count(*) AS n FROM panel GROUP BY ALL),
lab AS (SELECT algo_id, week_end, CASE WHEN n < 3 THEN 'inactive' WHEN r > 0.005 THEN 'high' WHEN r < -0.005 THEN 'low' ELSE 'mid' END AS label FROM wk)"""
)


def weekly_labels(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_add(F.trunc(F.date_add("date", 2), "week"), 4)
    wk = panel(spark, d).groupBy("algo_id", week.alias("week_end")).agg((F.product(1 + F.col("ret")) - 1).alias("r"), F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") < 3, "inactive").when(F.col("r") > 0.005, "high").when(F.col("r") < -0.005, "low").otherwise("mid")
    return wk.select("algo_id", "week_end", label.alias("label"))


@query(f"""
WITH {_WEEKLY}, x AS (SELECT algo_id, week_end, label, lag(label) OVER (PARTITION BY algo_id ORDER BY week_end) AS pv FROM lab WHERE label <> 'inactive'), c AS (SELECT algo_id, label, count(*) AS k FROM x GROUP BY ALL), m AS (SELECT algo_id, arg_min(label, (-k, label)) AS mode FROM c GROUP BY algo_id)
SELECT x.algo_id, count(*) AS n, count_if(pv <> label) AS changes, any_value(m.mode) AS mode, count(DISTINCT label) AS "distinct", round(CASE WHEN count(*) >= 2 THEN 1 - count_if(pv <> label) * 1.0 / (count(*) - 1) ELSE 1 END, 8) AS stability FROM x JOIN m USING (algo_id) GROUP BY x.algo_id""", digits=8)
def cluster_stability(spark: SparkSession, d: str) -> DataFrame:
    out = rg.stability(weekly_labels(spark, d), "label")
    return out.select("algo_id", "n", F.col("changes").cast("long").alias("changes"), "mode", "distinct", "stability")


@query(f"""
WITH {_WEEKLY}, l AS (SELECT label, lead(label) OVER (PARTITION BY algo_id ORDER BY week_end) AS nx FROM lab), c AS (SELECT label AS "from", nx AS "to", count(*) AS n FROM l WHERE nx IS NOT NULL GROUP BY ALL)
SELECT "from", "to", n, round(n / sum(n) OVER (PARTITION BY "from"), 8) AS p FROM c""", digits=8)
def cluster_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rg.transitions(weekly_labels(spark, d).withColumnRenamed("week_end", "date"), "label", "algo_id")


@query(f"WITH {_WEEKLY}, c AS (SELECT week_end, count_if(label <> 'inactive') AS n FROM lab GROUP BY week_end) SELECT arg_max(week_end, (n, -epoch(week_end))) AS week_end, max(n) AS n FROM c")
def busiest_week(spark: SparkSession, d: str) -> DataFrame:
    c = weekly_labels(spark, d).groupBy("week_end").agg(F.count_if(F.col("label") != "inactive").alias("n"))
    return c.agg(F.max_by("week_end", F.struct("n", -F.unix_date("week_end"))).alias("week_end"), F.max("n").alias("n"))


@query(f"""
WITH {_WEEKLY}, mx AS (SELECT max(week_end) AS z FROM lab), s AS (SELECT label, exp(-(mx.z - l.week_end) / 90.0) AS w, wk.r FROM lab l JOIN wk USING (algo_id, week_end), mx WHERE label <> 'inactive')
SELECT label, count(*) AS n, round(sum(w * r) / sum(w), 8) + 0.0 AS score FROM s GROUP BY label""", digits=8)
def cluster_alpha_scores(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_add(F.trunc(F.date_add("date", 2), "week"), 4)
    wk = panel(spark, d).groupBy("algo_id", week.alias("week_end")).agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    j = weekly_labels(spark, d).join(wk, ["algo_id", "week_end"])
    latest = j.agg(F.max("week_end").alias("z"))
    s = with_single(j.filter("label <> 'inactive'"), latest).withColumn("w", F.exp(-F.datediff("z", "week_end") / 90.0))
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("score"))


@query(f"""
WITH {PANEL}, {FAMILIES}, s AS (SELECT p.algo_id, f.family, avg(ret) / nullif(stddev_samp(ret), 0) AS x FROM panel p JOIN fam f USING (algo_id) GROUP BY ALL), m AS (SELECT family, quantile_cont(x, 0.5) AS med, count(*) AS n FROM s GROUP BY family)
SELECT family, round(med, 8) + 0.0 AS median_score, n, med >= (SELECT quantile_cont(med, 0.5) FROM m) AS kept FROM m""", digits=8)
def family_filter(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d).join(families(spark, d), "algo_id").groupBy("algo_id", "family").agg(F.avg("ret").alias("a"), F.stddev_samp("ret").alias("b"))
    m = s.withColumn("x", F.col("a") / F.when(F.col("b") != 0, F.col("b"))).groupBy("family").agg(F.expr("percentile(x, 0.5)").alias("median_score"), F.count(F.lit(1)).alias("n"))
    mid = m.agg(F.expr("percentile(median_score, 0.5)").alias("mid"))
    return with_single(m, mid).select("family", "median_score", "n", (F.col("median_score") >= F.col("mid")).alias("kept"))


@query(f"""
WITH {_HEURISTIC}, u AS (SELECT date, count(*) AS k, avg(ret) AS m FROM panel GROUP BY date), q AS (SELECT quantile_cont(k, 0.2) AS a, quantile_cont(k, 0.4) AS b, quantile_cont(k, 0.6) AS c, quantile_cont(k, 0.8) AS e FROM u),
x AS (SELECT CASE WHEN k <= a THEN 1 WHEN k <= b THEN 2 WHEN k <= c THEN 3 WHEN k <= e THEN 4 ELSE 5 END AS bucket, k, m FROM u, q)
SELECT bucket, count(*) AS n, min(k) AS lo, max(k) AS hi, round(avg(m), 10) + 0.0 AS mean_ret FROM x GROUP BY bucket""", digits=10)
def quantile_buckets(spark: SparkSession, d: str) -> DataFrame:
    u = panel(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("k"), F.avg("ret").alias("m"))
    q = u.agg(*(F.expr(f"percentile(k, {p})").alias(n) for p, n in ((0.2, "a"), (0.4, "b"), (0.6, "c"), (0.8, "e"))))
    bucket = F.when(F.col("k") <= F.col("a"), 1).when(F.col("k") <= F.col("b"), 2).when(F.col("k") <= F.col("c"), 3).when(F.col("k") <= F.col("e"), 4).otherwise(5)
    return with_single(u, q).withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.avg("m").alias("mean_ret"))
