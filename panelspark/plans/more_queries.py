"""Further queries: indices from weights, volatility targets, scorecards, class aggregates, comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from ..operators import allocate as al
from ..operators import backtest as bt
from ..operators import panel as px
from ..operators import swarm
from .base import FAMILIES, MARKET, NATION_PRICES, PANEL, TRADES, Registry, families, market, nation_panel, panel, trades
from .benchmark_queries import _ACTIVE, _FLOWS, _WEIGHTS, active, flows, weights
from .strategy_queries import _FACTORS, _HEURISTIC, _STEP, _WEEKLY, _stepped, heuristic, selected, weekly_labels

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"""
WITH {_WEIGHTS}, x AS (SELECT w.date, w.w / sum(w.w) OVER (PARTITION BY w.date) AS w, p.ret FROM weights w JOIN panel p USING (date, algo_id)), r AS (SELECT date, sum(w * least(ret, 1.0)) AS ret FROM x GROUP BY date),
f AS (SELECT date, CASE WHEN row_number() OVER (ORDER BY date) = 1 THEN 0 ELSE ret END AS ret FROM r)
SELECT date, round(ret, 8) + 0.0 AS ret, round(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 7) + 0.0 AS log_index FROM f""", digits=8)
def weighted_index(spark: SparkSession, d: str) -> DataFrame:
    """Same-day weights of those with a return, normalised per day; returns cut at 100 %; the first day counts 0."""
    x = weights(spark, d).join(nation_panel(spark, d).select("date", "algo_id", "ret"), ["date", "algo_id"])
    x = x.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("date")))
    r = x.groupBy("date").agg(F.sum(F.col("w") * F.least("ret", F.lit(1.0))).alias("ret"))
    w = Window.orderBy("date")
    r = r.withColumn("ret", F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col("ret")))
    return r.withColumn("log_index", F.round(F.sum(F.ln(1 + F.col("ret"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), 7))


@query(f"""
WITH {MARKET}, v AS (SELECT date, row_number() OVER (ORDER BY date) AS rn, stddev_samp(ret) OVER (ORDER BY date ROWS 20 PRECEDING) * sqrt(252) AS vol FROM market)
SELECT date, round(vol, 8) AS vol, round(greatest(least(0.10 / vol, 1.5), 0.1), 8) AS scale FROM v WHERE rn >= 21 AND vol > 1e-8""", digits=8)
def vol_target(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("date")
    v = market(spark, d).withColumn("rn", F.row_number().over(w)).withColumn("vol", F.stddev_samp("ret").over(w.rowsBetween(-20, 0)) * F.sqrt(F.lit(252.0)))
    return v.filter("rn >= 21 AND vol > 1e-8").select("date", "vol", F.greatest(F.least(0.10 / F.col("vol"), F.lit(1.5)), F.lit(0.1)).alias("scale"))


@query(f"""
WITH RECURSIVE {MARKET}, v AS (SELECT row_number() OVER (ORDER BY date) AS i, date, greatest(least(0.10 / nullif(stddev_samp(ret) OVER (ORDER BY date ROWS 20 PRECEDING) * sqrt(252), 0), 1.5), 0.1) AS s FROM market QUALIFY row_number() OVER (ORDER BY date) >= 21 AND s IS NOT NULL),
o AS (SELECT row_number() OVER (ORDER BY i) AS k, date, s FROM v), r AS (SELECT k, date, s AS scale FROM o WHERE k = 1 UNION ALL SELECT o.k, o.date, 0.9 * r.scale + 0.1 * o.s FROM r JOIN o ON o.k = r.k + 1)
SELECT date, round(scale, 8) AS scale FROM r""", digits=8)
def vol_target_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """A scale that keeps 0.9 of its last value: a fold over one array, a number a day."""
    w = Window.orderBy("date")
    raw = 0.10 / F.nullif(F.stddev_samp("ret").over(w.rowsBetween(-20, 0)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    v = market(spark, d).withColumn("rn", F.row_number().over(w)).withColumn("s", F.greatest(F.least(raw, F.lit(1.5)), F.lit(0.1))).withColumn("ok", raw.isNotNull()).filter("rn >= 21 AND ok")
    one = v.agg(F.array_sort(F.collect_list(F.struct("date", "s"))).alias("x"))
    start = F.array().cast("array<struct<date:date,scale:double>>")

    def step(acc, y):
        last = F.element_at(acc, -1)["scale"]
        return F.concat(acc, F.array(F.struct(y["date"].alias("date"), F.when(F.size(acc) == 0, y["s"]).otherwise(0.9 * F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["scale"]) + 0.1 * y["s"]).alias("scale"))))

    return one.select(F.explode(F.aggregate("x", start, step)).alias("r")).select("r.date", "r.scale")


@query(f"""
WITH {_HEURISTIC}, {FAMILIES}, j AS (SELECT r.regime, f.family, avg(p.ret) AS m, count(*) AS n FROM panel p JOIN regimes r USING (date) JOIN fam f USING (algo_id) GROUP BY ALL)
SELECT regime, family, round(m, 10) + 0.0 AS mean_ret, n, round(m - avg(m) OVER (PARTITION BY regime), 10) + 0.0 AS over_mean FROM j""", digits=10)
def family_by_regime(spark: SparkSession, d: str) -> DataFrame:
    j = panel(spark, d).join(heuristic(spark, d), "date").join(families(spark, d), "algo_id").groupBy("regime", "family").agg(F.avg("ret").alias("mean_ret"), F.count(F.lit(1)).alias("n"))
    return j.withColumn("over_mean", F.col("mean_ret") - F.avg("mean_ret").over(Window.partitionBy("regime")))


@query(f"""
WITH {PANEL}, {FAMILIES}, c AS (SELECT p.date, f.family, avg(p.ret) AS ret FROM panel p JOIN fam f USING (algo_id) GROUP BY ALL)
SELECT date, family, round(CASE WHEN count(*) OVER w >= 10 THEN avg(ret) OVER w END, 10) + 0.0 AS mean_21 FROM c WINDOW w AS (PARTITION BY family ORDER BY date ROWS 20 PRECEDING)""", digits=10)
def class_indicators(spark: SparkSession, d: str) -> DataFrame:
    c = panel(spark, d).join(families(spark, d), "algo_id").groupBy("date", "family").agg(F.avg("ret").alias("ret"))
    w = px.last_rows(px.by("family"), 21)
    return c.select("date", "family", F.when(F.count(F.lit(1)).over(w) >= 10, F.avg("ret").over(w)).alias("mean_21"))


@query(f"""
WITH {MARKET}, q AS (SELECT *, row_number() OVER (ORDER BY date) AS rn, stddev_samp(ret) OVER (ORDER BY date ROWS 20 PRECEDING) AS v, sum(ret) OVER (ORDER BY date ROWS 20 PRECEDING) AS t FROM market), f AS (SELECT date, v, t FROM q WHERE rn >= 21), l AS (SELECT quantile_cont(v, 0.75) AS hi FROM f)
SELECT date, CASE WHEN v > hi THEN 'high_vol' WHEN t > 0 THEN 'bull' ELSE 'bear' END AS regime FROM f, l""")
def index_regime_rules(spark: SparkSession, d: str) -> DataFrame:
    """Trend, overridden by high volatility against the quantile of the whole sample (which looks ahead)."""
    from ..sources.tables import with_single

    w = Window.orderBy("date")
    q = market(spark, d).withColumn("rn", F.row_number().over(w)).withColumn("v", F.stddev_samp("ret").over(px.last_rows(w, 21))).withColumn("t", F.sum("ret").over(px.last_rows(w, 21))).filter("rn >= 21")
    x = with_single(q.select("date", "v", "t"), q.agg(F.expr("percentile(v, 0.75)").alias("hi")))
    return x.select("date", F.when(F.col("v") > F.col("hi"), "high_vol").when(F.col("t") > 0, "bull").otherwise("bear").alias("regime"))


@query(f"""
WITH {_FACTORS}, wt AS (SELECT date, algo_id, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM sel), e AS (SELECT p.date, avg(p.ret) AS ret FROM panel p GROUP BY p.date), sd AS (SELECT DISTINCT date FROM wt),
dy AS (SELECT d.date, max(sd.date) AS since FROM (SELECT DISTINCT date FROM panel) d JOIN sd ON sd.date < d.date GROUP BY d.date),
b AS (SELECT dy.date, coalesce(sum(wt.w * p.ret), 0) AS ret FROM dy LEFT JOIN wt ON wt.date = dy.since LEFT JOIN panel p ON p.date = dy.date AND p.algo_id = wt.algo_id GROUP BY dy.date)
SELECT count(*) AS n, round(corr(b.ret, e.ret), 6) + 0.0 AS corr, round(stddev_samp(b.ret - e.ret), 6) AS te, round(sqrt(avg((b.ret - e.ret) * (b.ret - e.ret))), 6) AS rmse, round(max(abs(b.ret - e.ret)), 6) AS max_dev FROM b JOIN e USING (date)""")
def compare_series(spark: SparkSession, d: str) -> DataFrame:
    p = nation_panel(spark, d).select("date", "algo_id", "ret")
    b = bt.run(al.equal(selected(spark, d)).select("date", "algo_id", "w"), p).select("date", F.col("ret").alias("a"))
    j = b.join(p.groupBy("date").agg(F.avg("ret").alias("b")), "date").withColumn("x", F.col("a") - F.col("b"))
    return j.agg(F.count(F.lit(1)).alias("n"), corr("a", "b").alias("corr"), F.stddev_samp("x").alias("te"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rmse"), F.max(F.abs("x")).alias("max_dev"))


@query(f"""
WITH {_FACTORS}, {FAMILIES}, m AS (SELECT algo_id, avg(score) AS s, count(*) AS n FROM z GROUP BY algo_id), h AS (SELECT quantile_cont(s, 0.5) AS med FROM m)
SELECT algo_id, n, round(s, 6) + 0.0 AS score, round(CASE WHEN s >= med THEN 1.0 WHEN s >= 0 THEN 0.6 ELSE -0.25 END, 2) AS ladder FROM m, h""")
def score_ladder(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import with_single
    from .strategy_queries import factors

    m = factors(spark, d).groupBy("algo_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    x = with_single(m, m.agg(F.expr("percentile(score, 0.5)").alias("med")))
    return x.select("algo_id", "n", "score", F.when(F.col("score") >= F.col("med"), 1.0).when(F.col("score") >= 0, 0.6).otherwise(-0.25).alias("ladder"))


@query(f"""
WITH {TRADES}, o AS (SELECT algo_id, count(*) AS n, min(date_open) AS a, max(date_open) AS z, avg(date_diff('day', date_open, date_close)) AS mean_days, quantile_cont(date_diff('day', date_open, date_close), 0.5) AS median_days FROM t WHERE algo_id IS NOT NULL AND date_open IS NOT NULL AND date_close >= date_open GROUP BY algo_id)
SELECT algo_id, n, round(n / greatest((CAST(z AS DATE) - CAST(a AS DATE)) / 30.4375, 1), 6) AS per_month, round(mean_days, 6) AS mean_days, round(median_days, 6) AS median_days FROM o""")
def trading_pattern(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).filter("algo_id IS NOT NULL AND date_open IS NOT NULL AND date_close >= date_open").withColumn("days", F.datediff("date_close", "date_open"))
    o = t.groupBy("algo_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("date_open"), F.min("date_open")).alias("span"), F.avg("days").alias("mean_days"), F.expr("percentile(days, 0.5)").alias("median_days"))
    return o.select("algo_id", "n", (F.col("n") / F.greatest(F.col("span") / 30.4375, F.lit(1.0))).alias("per_month"), "mean_days", "median_days")


@query(f"""
WITH {PANEL}, d AS (SELECT algo_id, date, lead(date) OVER (PARTITION BY algo_id ORDER BY date) AS nx FROM panel), g AS (SELECT algo_id, date AS from_date, nx AS to_date, CAST(nx - date AS INT) AS days FROM d WHERE nx - date > 7)
SELECT algo_id, count(*) AS n, max(days) AS longest, CAST(sum(days) AS BIGINT) AS total FROM g GROUP BY algo_id""")
def pauses(spark: SparkSession, d: str) -> DataFrame:
    g = panel(spark, d).withColumn("days", F.datediff(F.lead("date").over(px.by("algo_id")), "date")).filter("days > 7")
    return g.groupBy("algo_id").agg(F.count(F.lit(1)).alias("n"), F.max("days").alias("longest"), F.sum("days").alias("total"))


@query(f"""
WITH {PANEL}, w AS (SELECT algo_id, date, ret, lead(ret) OVER o AS nx, sum(ret) OVER (o ROWS 9 PRECEDING) AS s10, row_number() OVER o AS rn FROM panel WINDOW o AS (PARTITION BY algo_id ORDER BY date))
SELECT algo_id, date, round(s10, 10) + 0.0 AS s10, round(nx, 10) + 0.0 AS reward FROM w WHERE rn >= 10 AND nx IS NOT NULL""", digits=10)
def transitions_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Rows of (state, next reward) with the state's last ten returns as an array, of which the sum is compared."""
    w = px.by("algo_id")
    x = panel(spark, d).withColumn("obs", F.collect_list("ret").over(px.last_rows(w, 10))).withColumn("reward", F.lead("ret").over(w)).filter("size(obs) = 10 AND reward IS NOT NULL")
    return x.select("algo_id", "date", F.aggregate("obs", F.lit(0.0), lambda a, v: a + v).alias("s10"), "reward")


def _searched(name: str, optimize) -> None:
    @query(name=name)
    def allocation(spark: SparkSession, d: str) -> DataFrame:
        """Weights at each quarter's first date from the last 63 dates, by search."""
        p = nation_panel(spark, d)
        sched = p.groupBy(F.trunc("date", "quarter")).agg(F.min("date").alias("date")).select("date")
        dense = px.densify(p, "algo_id", "ret", F.lit(0.0)).select("algo_id", "date", "ret")
        return bt.allocate(dense, sched, 63, optimize)


_searched("alloc_particle_swarm", swarm.particle_swarm)
_searched("alloc_ant_colony", swarm.ant_colony)


@query(f"""
WITH {NATION_PRICES}, {_ACTIVE} SELECT a.date, round(sum(a.total * p.ret) / sum(a.total), 8) + 0.0 AS ret, count(*) AS n FROM active a JOIN panel p USING (date, algo_id) WHERE a.total > 0 GROUP BY a.date""", digits=8)
def open_trades_return(spark: SparkSession, d: str) -> DataFrame:
    """Per day the return of the capital in open trades."""
    j = active(spark, d).join(nation_panel(spark, d).select("date", "algo_id", "ret"), ["date", "algo_id"]).filter("total > 0")
    return j.groupBy("date").agg((F.sum(F.col("total") * F.col("ret")) / F.sum("total")).alias("ret"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_FLOWS}, s AS (SELECT date, 1 - least(abs(flow) / nullif(abs(equity), 0), 0.9) AS scale FROM flows) SELECT date, round(scale, 8) AS scale FROM s""", digits=8)
def cash_flow_scale(spark: SparkSession, d: str) -> DataFrame:
    """The factor by which a day's volume weights shrink with its cash flow."""
    share = F.abs("flow") / F.nullif(F.abs("equity"), F.lit(0.0))
    return flows(spark, d).select("date", F.when(share.isNotNull(), 1 - F.least(share, F.lit(0.9))).alias("scale"))


_HORIZONS = (
    PANEL
    + """, hz AS (SELECT algo_id, date, row_number() OVER o AS rn, avg(ret) OVER (o ROWS 4 PRECEDING) AS w, avg(ret) OVER (o ROWS 20 PRECEDING) AS m, avg(ret) OVER (o ROWS UNBOUNDED PRECEDING) AS c FROM panel WINDOW o AS (PARTITION BY algo_id ORDER BY date)),
hl AS (SELECT algo_id, date, CASE WHEN rn >= 5 THEN CASE WHEN w > 1e-9 THEN 'up' ELSE 'down' END END AS weekly, CASE WHEN rn >= 21 THEN CASE WHEN m > 1e-9 THEN 'up' ELSE 'down' END END AS monthly, CASE WHEN c > 1e-9 THEN 'up' ELSE 'down' END AS cumulative FROM hz)"""
)


@query(f"""
WITH {_HORIZONS} SELECT algo_id, date, CASE WHEN CAST(weekly IS NOT NULL AS INT) + CAST(monthly IS NOT NULL AS INT) + 1 < 2 THEN NULL ELSE coalesce(weekly, cumulative) = cumulative AND coalesce(monthly, cumulative) = cumulative END AS consistent FROM hl""")
def horizon_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Whether the labels of three horizons agree; null with fewer than two of them."""
    w = px.by("algo_id")
    label = lambda n: F.when(F.avg("ret").over(px.last_rows(w, n) if n else px.so_far(w)) > 1e-9, "up").otherwise("down")
    x = panel(spark, d).withColumn("rn", F.row_number().over(w))
    labels = F.array_compact(F.array(F.when(F.col("rn") >= 5, label(5)), F.when(F.col("rn") >= 21, label(21)), label(0)))
    x = x.withColumn("l", labels)
    return x.select("algo_id", "date", F.when(F.size("l") >= 2, F.size(F.array_distinct("l")) == 1).alias("consistent"))


@query(f"""
WITH {PANEL}, {FAMILIES}, s AS (SELECT algo_id, avg(ret) / nullif(stddev_samp(ret), 0) AS x FROM panel GROUP BY algo_id), g AS (SELECT 'universe' AS side, x FROM s UNION ALL SELECT 'trend', s.x FROM s JOIN fam USING (algo_id) WHERE family = 'trend')
SELECT side, count(*) AS n, round(avg(x), 8) + 0.0 AS mean, round(quantile_cont(x, 0.25), 8) + 0.0 AS p25, round(quantile_cont(x, 0.5), 8) + 0.0 AS median, round(quantile_cont(x, 0.75), 8) + 0.0 AS p75 FROM g GROUP BY side""", digits=8)
def group_against_universe(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d).groupBy("algo_id").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("x"))
    trend = s.join(families(spark, d).filter("family = 'trend'"), "algo_id", "left_semi")
    g = s.select(F.lit("universe").alias("side"), "x").unionByName(trend.select(F.lit("trend").alias("side"), "x"))
    q = [F.expr(f"percentile(x, {p})").alias(n) for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    return g.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), *q)


@query(f"""
WITH {_WEEKLY}, j AS (SELECT l.label, wk.r, wk.algo_id FROM lab l JOIN wk USING (algo_id, week_end))
SELECT label, count(*) AS n, count(DISTINCT algo_id) AS algos, round(100.0 * count(*) / sum(count(*)) OVER (), 8) AS pct, round(avg(r), 8) + 0.0 AS mean, round(stddev_samp(r), 8) AS std FROM j GROUP BY label""", digits=8)
def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_add(F.trunc(F.date_add("date", 2), "week"), 4)
    wk = panel(spark, d).groupBy("algo_id", week.alias("week_end")).agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    g = weekly_labels(spark, d).join(wk, ["algo_id", "week_end"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("algo_id").alias("algos"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))
    return g.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


@query(f"""
WITH {_HEURISTIC}, l AS (SELECT regime, date FROM regimes ORDER BY date DESC LIMIT 5), c AS (SELECT regime, count(*) AS n FROM l GROUP BY regime) SELECT arg_min(regime, (-n, regime)) AS regime, max(n) AS n FROM c""")
def current_regime(spark: SparkSession, d: str) -> DataFrame:
    """The commonest of the last five labels, the first by name of equals."""
    last = heuristic(spark, d).orderBy(F.col("date").desc()).limit(5)
    return last.groupBy("regime").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("regime", F.struct(-F.col("n"), "regime")).alias("regime"), F.max("n").alias("n"))


@query(f"""
WITH {_STEP}, v AS (SELECT date, max(greatest(w - 0.28, 0)) AS a, max(greatest(0.08 - w, 0)) AS b, sum(w) - 0.9 AS c, sum(abs(w - current)) / 2 - 0.02 AS d FROM c4 GROUP BY date)
SELECT date, a > 1e-6 AS max_weight, b > 1e-6 AS min_weight, c > 1e-6 AS exposure, d > 1e-6 AS turnover, round(least(greatest(a, 0) / 0.28, 1), 8) AS severity FROM v""", digits=8)
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Which limits a date's weights exceed, and how severely the greatest weight."""
    x = _stepped(spark, d)
    v = x.groupBy("date").agg(F.max(F.greatest(F.col("w") - 0.28, F.lit(0.0))).alias("a"), F.max(F.greatest(0.08 - F.col("w"), F.lit(0.0))).alias("b"), (F.sum("w") - 0.9).alias("c"), (F.sum(F.abs(F.col("w") - F.col("current"))) / 2 - 0.02).alias("e"))
    over = lambda c, n: (F.col(c) > 1e-6).alias(n)
    return v.select("date", over("a", "max_weight"), over("b", "min_weight"), over("c", "exposure"), over("e", "turnover"), F.least(F.col("a") / 0.28, F.lit(1.0)).alias("severity"))
