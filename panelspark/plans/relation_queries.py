"""Queries on values in force at a date, sub-periods, scorecards, folds with static weights and sheets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from ..operators import allocate as al
from ..operators import backtest as bt
from ..operators import benchmark as bm
from ..operators import panel as px
from ..operators import relations as rl
from ..sources.tables import table, with_single
from .base import ENRICHED, FAMILIES, MARKET, NATION_PRICES, NATION_TRADES, PANEL, Registry, families, market, nation_panel, nation_trades, panel
from .benchmark_queries import _FLOWS, flows
from .strategy_queries import _FACTORS, _HEURISTIC, _STEP, _WEEKLY, _stepped, heuristic, selected, weekly_labels

query = Registry()
QUERIES, SQL = query.queries, query.sql
_R = "sqrt(252)"
_DAY = "strftime({0}, '%Y-%m-%d')"

# The first date of each month, and of the third month on.
_MONTHS = "months AS (SELECT min(date) AS date FROM panel GROUP BY date_trunc('month', date))"


def _months(p: DataFrame) -> DataFrame:
    return p.groupBy(F.trunc("date", "MM")).agg(F.min("date").alias("date")).select("date")


@query(f"""
WITH {PANEL}, {_MONTHS}, f AS (SELECT algo_id, CAST(date AS DATE) AS date, max(rolling_sharpe_21d) AS s FROM algo_features GROUP BY ALL), a AS (SELECT m.date, max(f.date) AS since FROM months m JOIN (SELECT DISTINCT date FROM f) f ON f.date <= m.date GROUP BY m.date)
SELECT {_DAY.format('a.date')} AS date, {_DAY.format('a.since')} AS since, f.algo_id, round(f.s, 6) + 0.0 AS sharpe FROM a JOIN f ON f.date = a.since""")
def features_asof(spark: SparkSession, d: str) -> DataFrame:
    """At each month's first date the last row of features, one date for all algorithms."""
    f = table(spark, d, "algo_features").groupBy("algo_id", F.col("date").cast("date").alias("date")).agg(F.max("rolling_sharpe_21d").alias("sharpe"))
    return rl.rows_in_force(_months(panel(spark, d)), f).select("date", "since", "algo_id", "sharpe")


@query(f"""
WITH {_HEURISTIC}, {_MONTHS}, a AS (SELECT m.date, max(r.date) AS since FROM months m JOIN regimes r ON r.date <= m.date GROUP BY m.date)
SELECT {_DAY.format('a.date')} AS date, r.regime FROM a JOIN regimes r ON r.date = a.since""")
def regime_asof(spark: SparkSession, d: str) -> DataFrame:
    return rl.rows_in_force(_months(panel(spark, d)), heuristic(spark, d)).select("date", "regime")


@query(f"""
WITH {_WEEKLY}, {_MONTHS}, a AS (SELECT m.date, max(l.week_end) AS since FROM months m JOIN (SELECT DISTINCT week_end FROM lab) l ON l.week_end <= m.date GROUP BY m.date), u AS (SELECT DISTINCT algo_id FROM panel)
SELECT {_DAY.format('a.date')} AS date, u.algo_id, l.label FROM a CROSS JOIN u LEFT JOIN lab l ON l.week_end = a.since AND l.algo_id = u.algo_id""")
def cluster_week_asof(spark: SparkSession, d: str) -> DataFrame:
    """At each month's first date every algorithm's label of the last week that has any; null where it has none in that week."""
    p, lab = panel(spark, d), weekly_labels(spark, d).withColumnRenamed("week_end", "date")
    at = rl.in_force(_months(p), lab).filter("since IS NOT NULL")
    dates = at.agg(F.collect_list(F.struct("date", "since")).alias("at"))  # one row, a date a month
    every = with_single(p.select("algo_id").distinct(), dates).select("algo_id", F.explode("at").alias("a")).select("algo_id", "a.*")
    return every.join(lab.withColumnRenamed("date", "since"), ["since", "algo_id"], "left").select("date", "algo_id", "label")


@query(f"""
WITH {PANEL}, m0 AS (SELECT min(date) AS date FROM panel GROUP BY date_trunc('month', date)), months AS (SELECT date FROM m0 ORDER BY date OFFSET 2), w AS (SELECT p.date, p.algo_id, 1.0 / count(*) OVER (PARTITION BY p.date) AS w FROM panel p JOIN months USING (date)),
a AS (SELECT d.date, coalesce(max(m.date), (SELECT min(date) FROM months)) AS since FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN months m ON m.date <= d.date GROUP BY d.date)
SELECT {_DAY.format('a.date')} AS date, {_DAY.format('a.since')} AS since, count(*) AS n, round(sum(w.w * coalesce(p.ret, 0)), 8) + 0.0 AS ret FROM a JOIN w ON w.date = a.since LEFT JOIN panel p ON p.date = a.date AND p.algo_id = w.algo_id GROUP BY ALL""", digits=8)
def weights_asof_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Returns under the last weights set, those of the first rebalance before it; weights are set from the third month on."""
    p = panel(spark, d).select("date", "algo_id", "ret")
    months = _months(p).withColumn("i", F.row_number().over(Window.orderBy("date"))).filter("i > 2").select("date")
    w = p.join(months, "date").withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date"))).select("date", "algo_id", "w")
    held = rl.rows_in_force(p.select("date"), w, clamp=True)
    return held.join(p, ["date", "algo_id"], "left").groupBy("date", "since").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


@query(f"""
WITH {_FLOWS}, b AS (SELECT date FROM flows WHERE abs(flow) / nullif(abs(pe), 0) > 0.01 UNION SELECT min(date) FROM flows UNION SELECT max(date) FROM flows), n AS (SELECT date AS a, lead(date) OVER (ORDER BY date) AS z, row_number() OVER (ORDER BY date) AS part FROM b)
SELECT n.part, {_DAY.format('min(f.date)')} AS first, {_DAY.format('max(f.date)')} AS last, round(product(1 + coalesce(f.ret, 0)) - 1, 8) + 0.0 AS ret FROM n JOIN flows f ON f.date BETWEEN n.a AND n.z GROUP BY n.part""", digits=8)
def twr_shared_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Sub-periods that include the flow's day at both ends, the reference's variant; twr_subperiods counts each day once."""
    return rl.shared_subperiods(flows(spark, d)).withColumn("part", F.col("part").cast("long"))


_TWO = f"{MARKET}, h AS (SELECT date, avg(ret) AS ret FROM panel WHERE algo_id < 'M' GROUP BY date), j AS (SELECT m.date, product(1 + m.ret) OVER o AS a, product(1 + h.ret) OVER o AS r FROM market m JOIN h USING (date) WINDOW o AS (ORDER BY m.date ROWS UNBOUNDED PRECEDING))"


@query(f"""
WITH {_TWO}, f AS (SELECT arg_min(a, date) AS a0, arg_min(r, date) AS r0 FROM j), x AS (SELECT date, a / a0 * 100 AS a, r / r0 * 100 AS r FROM j, f), l AS (SELECT *, ln(a / lag(a) OVER (ORDER BY date)) AS la, ln(r / lag(r) OVER (ORDER BY date)) AS lr FROM x), ma AS (SELECT avg(la) AS m FROM l WHERE la IS NOT NULL),
mo AS (SELECT arg_max(a, date) AS a, arg_max(r, date) AS r FROM x GROUP BY date_trunc('month', date))
SELECT count(*) AS n_days, round(corr(la, lr), 6) AS correlation_daily, round(1 - sum((la - lr) * (la - lr)) / sum((la - ma.m) * (la - ma.m)), 6) + 0.0 AS r_squared, round(stddev_samp(la - lr) * {_R}, 6) AS tracking_error_annual, round(sqrt(avg((r - a) * (r - a))), 6) AS rmse_index, round(max(abs(r - a)), 6) AS max_deviation,
  round((arg_max(r, date) - arg_max(a, date)) / arg_max(a, date) * 100, 6) + 0.0 AS final_diff_pct, round((SELECT CASE WHEN count(*) > 3 THEN corr(a, r) ELSE 0 END FROM mo), 6) AS monthly_correlation FROM l, ma""")
def recon_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A reconstruction (part of the algorithms) held against the actual index."""
    half = panel(spark, d).filter("algo_id < 'M'").groupBy("date").agg(F.avg("ret").alias("r"))
    o = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = market(spark, d).select("date", F.col("ret").alias("a")).join(half, "date")
    j = j.select("date", F.product(1 + F.col("a")).over(o).alias("a"), F.product(1 + F.col("r")).over(o).alias("r"))
    return bm.reconstruction_statistics(j)


@query(f"""
WITH {_STEP}, t AS (SELECT date, sum(abs(w - current)) / 2 AS t FROM c4 GROUP BY date)
SELECT {_DAY.format('date')} AS date, round(t, 8) AS turnover, round(t * 0.001, 10) AS linear_cost, round(t * 0.001 + t * 0.0005 + 0.1 * pow(t, 1.5), 10) AS impact_cost FROM t""", digits=10)
def cost_variants(spark: SparkSession, d: str) -> DataFrame:
    """Costs by turnover alone: basis points, and basis points with an impact of turnover to the power of 1.5."""
    t = _stepped(spark, d).groupBy("date").agg((F.sum(F.abs(F.col("w") - F.col("current"))) / 2).alias("t"))
    return t.select("date", F.round("t", 8).alias("turnover"), (F.col("t") * 0.001).alias("linear_cost"), (F.col("t") * 0.001 + F.col("t") * 0.0005 + 0.1 * F.pow("t", F.lit(1.5))).alias("impact_cost"))


@query(f"""
WITH {PANEL}, {FAMILIES}, s AS (SELECT p.algo_id, CASE WHEN stddev_samp(ret) > 1e-10 THEN avg(ret) / stddev_samp(ret) * {_R} ELSE 0 END AS x FROM panel p GROUP BY p.algo_id), m AS (SELECT family, quantile_cont(x, 0.5) AS score FROM s JOIN fam USING (algo_id) GROUP BY family),
w AS (SELECT p.date, p.algo_id, abs(p.ret) AS w FROM panel p)
SELECT {_DAY.format('w.date')} AS date, round(coalesce(sum(w.w * coalesce(m.score, 0)) / nullif(sum(w.w), 0), 0), 8) + 0.0 AS bonus FROM w LEFT JOIN fam USING (algo_id) LEFT JOIN m USING (family) GROUP BY w.date""", digits=8)
def soft_bonus(spark: SparkSession, d: str) -> DataFrame:
    """Per date the mean score of the families held, by weight (the size of the return here); a family's score is its median Sharpe, 0 without one."""
    p, f = panel(spark, d), families(spark, d)
    dev = F.stddev_samp("ret")
    s = p.groupBy("algo_id").agg(F.when(dev > 1e-10, F.avg("ret") / F.when(dev > 1e-10, dev) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("x"))
    score = s.join(f, "algo_id").groupBy("family").agg(F.expr("percentile(x, 0.5)").alias("score"))
    w = p.select("date", "algo_id", F.abs("ret").alias("w")).join(f, "algo_id", "left").join(score, "family", "left")
    total = F.sum("w")
    return w.groupBy("date").agg(F.coalesce(F.sum(F.col("w") * F.coalesce("score", F.lit(0.0))) / F.when(total > 0, total), F.lit(0.0)).alias("bonus"))


_BOARD = f"""{MARKET}, u AS (SELECT date, (count(*) FILTER (ret > 0) - count(*) FILTER (ret < 0)) / (count(*) FILTER (ret > 0) + count(*) FILTER (ret < 0) + 1.0) AS breadth FROM panel GROUP BY date),
v AS (SELECT m.date, u.breadth, CASE WHEN row_number() OVER o >= 21 THEN stddev_samp(m.ret) OVER (ORDER BY m.date ROWS 20 PRECEDING) * {_R} END AS vol, product(1 + m.ret) OVER (ORDER BY m.date ROWS UNBOUNDED PRECEDING) AS p FROM market m JOIN u USING (date) WINDOW o AS (ORDER BY m.date)),
y AS (SELECT *, p / max(p) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, quantile_cont(vol, 0.5) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS md, CASE WHEN row_number() OVER (ORDER BY date) >= 21 THEN avg(breadth) OVER (ORDER BY date ROWS 20 PRECEDING) END AS br FROM v),
z AS (SELECT date, 1 / (1 + exp(-br / 0.5)) AS g, 1 / (1 + exp(-(vol - md) / nullif((SELECT avg(md) FROM y) * 0.5, 0))) AS h, abs(dd) AS s FROM y)"""


@query(f"""
WITH {_BOARD}, c AS (SELECT *, round(g * (1 - s) * (1 - h), 12) AS a, round(g * h * (1 - s), 12) AS b, round(s * h * (1 - g), 12) AS r, round((1 - s) * (1 - h) * (1 - g) * 0.5 + g * 0.5, 12) AS e, coalesce(g * (1 - h), 0) + coalesce(g * h, 0) + coalesce(s * h, 0) + coalesce((1 - s) * (1 - g), 0) + 1e-10 AS t FROM z)
SELECT {_DAY.format('date')} AS date, round(g, 6) AS growth, round(h, 6) AS high_vol, round(s, 6) AS stress, round(1 - s, 6) AS risk_on, CASE WHEN g IS NULL OR h IS NULL OR a = greatest(a, b, r, e) THEN 0 WHEN b = greatest(a, b, r, e) THEN 1 WHEN r = greatest(a, b, r, e) THEN 2 ELSE 3 END AS regime,
  round(g * (1 - h) / t, 6) AS p0, round(g * h / t, 6) AS p1, round(s * h / t, 6) AS p2, round((1 - s) * (1 - g) / t, 6) AS p3 FROM c""")
def regime_scorecard(spark: SparkSession, d: str) -> DataFrame:
    u = panel(spark, d).groupBy("date").agg(F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.col("ret") < 0).alias("down"))
    o = Window.orderBy("date")
    m = market(spark, d).select("date", "ret").join(u, "date").withColumn("breadth", (F.col("up") - F.col("down")) / (F.col("up") + F.col("down") + 1.0))
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("vol", F.when(F.row_number().over(o) >= 21, F.stddev_samp("ret").over(o.rowsBetween(-20, 0)) * F.sqrt(F.lit(252.0)))).withColumn("p", F.product(1 + F.col("ret")).over(upto))
    return rl.scorecard(m.select("date", "breadth", "vol", (F.col("p") / F.max("p").over(upto) - 1).alias("drawdown")))


_PROFILES = f"pr AS (SELECT algo_id, CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(*)) - 1 ELSE -1 END AS y, stddev_samp(ret) * {_R} AS v, CASE WHEN stddev_samp(ret) > 1e-10 THEN avg(ret) / stddev_samp(ret) * {_R} ELSE 0 END AS sh FROM panel GROUP BY algo_id)"


def _profiles(p: DataFrame) -> DataFrame:
    dev, grown = F.stddev_samp("ret"), F.product(1 + F.col("ret"))
    return p.groupBy("algo_id").agg(
        F.when(grown > 0, F.pow(F.when(grown > 0, grown), 252.0 / F.count(F.lit(1))) - 1).otherwise(-1.0).alias("y"), (dev * F.sqrt(F.lit(252.0))).alias("v"), F.when(dev > 1e-10, F.avg("ret") / F.when(dev > 1e-10, dev) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sh")
    )


@query(f"""
WITH {PANEL}, {FAMILIES}, {_PROFILES}, g AS (SELECT family, avg(y) AS y, avg(v) AS v, avg(sh) AS sh FROM pr JOIN fam USING (algo_id) GROUP BY family), q AS (SELECT *, round(coalesce(0.65 * sh + 0.35 * y / nullif(v, 0), 0), 9) AS quality FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY quality DESC, round(y, 9) DESC, family) AS k FROM q)
SELECT family, round(quality, 6) + 0.0 AS quality, CASE WHEN k = 1 THEN 1.0 WHEN k = 2 THEN 0.6 WHEN y <= 0 OR sh <= 0 THEN -0.75 ELSE -0.25 END AS score FROM r""")
def family_alpha_scores(spark: SparkSession, d: str) -> DataFrame:
    """Families ranked by 0.65 Sharpe and 0.35 return over volatility; the best 1, the second 0.6, the others -0.25, losing ones -0.75."""
    p = panel(spark, d)
    g = _profiles(p).join(families(spark, d), "algo_id").groupBy("family").agg(*(F.avg(c).alias(c) for c in ("y", "v", "sh")))
    q = g.withColumn("quality", F.round(F.coalesce(0.65 * F.col("sh") + 0.35 * F.col("y") / F.when(F.col("v") != 0, F.col("v")), F.lit(0.0)), 9))
    k = F.row_number().over(Window.orderBy(F.col("quality").desc(), F.round("y", 9).desc(), "family"))  # a row a family
    return q.withColumn("k", k).select("family", "quality", F.when(F.col("k") == 1, 1.0).when(F.col("k") == 2, 0.6).when((F.col("y") <= 0) | (F.col("sh") <= 0), -0.75).otherwise(-0.25).alias("score"))


# Labels of three horizons at each week's end: the week, the month to date, all time to date; by compounded return.
_HORIZONS = f"""{PANEL}, wk AS (SELECT algo_id, date, ret, CAST(date_trunc('week', date + 2) AS DATE) + 4 AS week_end FROM panel), lw AS (SELECT algo_id, week_end, max(date) AS date FROM wk GROUP BY ALL),
cu AS (SELECT algo_id, date, product(1 + ret) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS c, product(1 + ret) OVER (PARTITION BY algo_id, date_trunc('month', date) ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS m FROM panel),
ww AS (SELECT algo_id, week_end, product(1 + ret) - 1 AS w FROM wk GROUP BY ALL),
lb AS (SELECT lw.algo_id, lw.week_end, unnest(['cumulative', 'monthly', 'weekly']) AS horizon, unnest([cu.c, cu.m, ww.w]) AS r FROM lw JOIN cu USING (algo_id, date) JOIN ww USING (algo_id, week_end)),
la AS (SELECT algo_id, week_end, horizon, CASE WHEN r > 0.005 THEN 'high' WHEN r < -0.005 THEN 'low' ELSE 'mid' END AS label FROM lb)"""


def horizon_labels(p: DataFrame) -> DataFrame:
    w = Window.partitionBy("algo_id").orderBy("date")
    week = F.date_add(F.trunc(F.date_add("date", 2), "week"), 4)
    upto = lambda s: F.product(1 + F.col("ret")).over(s.rowsBetween(Window.unboundedPreceding, 0)) - 1
    x = p.withColumn("week_end", week).withColumn("cumulative", upto(w)).withColumn("monthly", upto(Window.partitionBy("algo_id", F.trunc("date", "MM")).orderBy("date"))).withColumn("weekly", upto(Window.partitionBy("algo_id", "week_end").orderBy("date")))
    last = x.groupBy("algo_id", "week_end").agg(F.max_by(F.struct("cumulative", "monthly", "weekly"), "date").alias("h")).select("algo_id", "week_end", "h.*")
    r = last.unpivot(["algo_id", "week_end"], ["cumulative", "monthly", "weekly"], "horizon", "r")
    return r.select("algo_id", "week_end", "horizon", F.when(F.col("r") > 0.005, "high").when(F.col("r") < -0.005, "low").otherwise("mid").alias("label"))


@query(f"WITH {_HORIZONS} SELECT algo_id, {_DAY.format('week_end')} AS week_end, horizon, label FROM la")
def labels_three_horizons(spark: SparkSession, d: str) -> DataFrame:
    return horizon_labels(panel(spark, d))


@query(f"""
WITH {_HORIZONS}, {_PROFILES}, mx AS (SELECT max(week_end) AS z FROM la), j AS (SELECT la.horizon, la.label, exp(-(mx.z - la.week_end) / 90.0) AS w, pr.* FROM la JOIN pr USING (algo_id), mx),
g AS (SELECT horizon, label, sum(w) AS sw, sum(w * y) / sum(w) AS y, sum(w * v) / sum(w) AS v, sum(w * sh) / sum(w) AS sh FROM j GROUP BY ALL), q AS (SELECT *, round(coalesce(0.8 * sh + 0.2 * y / nullif(v, 0), -1) * ln(1 + sw), 9) AS quality FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY quality DESC, round(y, 9) DESC, label) AS k FROM q)
SELECT horizon, label, round(quality, 6) + 0.0 AS quality, CASE WHEN k = 1 THEN 1.0 WHEN k = 2 THEN CASE WHEN quality > 0 THEN 0.6 ELSE 0.2 END WHEN quality > 0 THEN -0.05 WHEN y > 0 THEN -0.2 ELSE -0.5 END AS score FROM r""")
def cluster_alpha_by_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each horizon scored by their members' profiles, recent weeks counting more (exp(-days / 90))."""
    p = panel(spark, d)
    lab = horizon_labels(p)
    j = with_single(lab.join(_profiles(p), "algo_id"), lab.agg(F.max("week_end").alias("z"))).withColumn("w", F.exp(-F.datediff("z", "week_end") / 90.0))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    g = j.groupBy("horizon", "label").agg(F.sum("w").alias("sw"), mean("y"), mean("v"), mean("sh"))
    q = g.withColumn("quality", F.round(F.coalesce(0.8 * F.col("sh") + 0.2 * F.col("y") / F.when(F.col("v") != 0, F.col("v")), F.lit(-1.0)) * F.log1p("sw"), 9))
    k = F.row_number().over(Window.partitionBy("horizon").orderBy(F.col("quality").desc(), F.round("y", 9).desc(), "label"))
    good = F.col("quality") > 0
    score = F.when(F.col("k") == 1, 1.0).when(F.col("k") == 2, F.when(good, 0.6).otherwise(0.2)).when(good, -0.05).when(F.col("y") > 0, -0.2).otherwise(-0.5)
    return q.withColumn("k", k).select("horizon", "label", "quality", score.alias("score"))


@query("""
WITH b AS (SELECT event_type, time_bucket(INTERVAL 4 HOUR, ts) AS bin, sum(value) AS total, arg_max(value, (ts, event_id)) AS last FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL), e AS (SELECT event_type, min(bin) AS a, max(bin) AS z FROM b GROUP BY event_type),
g AS (SELECT event_type, unnest(generate_series((SELECT max(a) FROM e), (SELECT min(z) FROM e), INTERVAL 4 HOUR)) AS bin FROM e)
SELECT g.event_type, strftime(g.bin, '%Y-%m-%d %H:%M:%S.%f') AS bin, round(coalesce(b.total, 0), 6) + 0.0 AS total, round(b.last, 6) + 0.0 AS last FROM g LEFT JOIN b USING (event_type, bin)""")
def resample_4h_dense(spark: SparkSession, d: str) -> DataFrame:
    """Bins of four hours that all event types span; an empty one has the sum 0 and no last value."""
    e = table(spark, d, "events").filter("event_type IS NOT NULL AND ts IS NOT NULL")
    b = e.groupBy("event_type", F.window("ts", "4 hours").alias("w")).agg(F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last")).select("event_type", F.col("w.start").alias("bin"), "total", "last")
    ends = b.groupBy("event_type").agg(F.min("bin").alias("a"), F.max("bin").alias("z"))
    span = ends.agg(F.max("a").alias("a"), F.min("z").alias("z"))
    blocks = with_single(ends.select("event_type"), span).filter("a <= z").select("event_type", "z", F.explode(F.sequence("a", "z", F.expr("interval 30 days"))).alias("s"))
    bins = blocks.select("event_type", F.explode(F.sequence("s", F.least("z", F.col("s") + F.expr("interval 30 days") - F.expr("interval 4 hours")), F.expr("interval 4 hours"))).alias("bin"))
    return bins.join(b, ["event_type", "bin"], "left").select("event_type", "bin", F.coalesce("total", F.lit(0.0)).alias("total"), "last")


@query(f"""
WITH {ENRICHED}, o AS (SELECT *, row_number() OVER (PARTITION BY algo_id ORDER BY ret) - 1 AS i, count(*) OVER (PARTITION BY algo_id) AS n, greatest(max(p) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING), 1) AS pk FROM enriched),
u AS (SELECT *, sum(CASE WHEN p >= pk THEN 1 ELSE 0 END) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS isl FROM o), du AS (SELECT algo_id, max(k) AS k FROM (SELECT algo_id, isl, count(*) FILTER (p < pk) AS k FROM u GROUP BY ALL) GROUP BY algo_id),
g AS (SELECT algo_id, count(*) AS n, CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(*)) - 1 ELSE -1 END AS y, stddev_samp(ret) AS s, avg(ret) AS m, sqrt(avg(ret * ret) FILTER (ret < 0)) AS ds, count(*) FILTER (ret < 0) AS losses, min(p / pk - 1) AS mdd,
  max(ret) FILTER (i = CAST(floor(0.05 * n) AS BIGINT)) AS va, avg(ret) FILTER (i < greatest(CAST(floor(0.05 * n) AS BIGINT), 1)) AS cva, max(ret) FILTER (i = CAST(floor(0.95 * n) AS BIGINT)) AS hi FROM u GROUP BY algo_id)
SELECT g.algo_id, round(CASE WHEN n < 10 THEN 0 ELSE y END, 6) + 0.0 AS ann_return, round(CASE WHEN n < 10 THEN 0 ELSE s * {_R} END, 6) AS ann_vol, round(CASE WHEN n < 10 OR s < 1e-10 THEN 0 ELSE m / s * {_R} END, 6) + 0.0 AS sharpe, round(CASE WHEN n < 10 OR losses < 2 OR ds < 1e-10 THEN 0 ELSE m / ds * {_R} END, 6) + 0.0 AS sortino,
  round(CASE WHEN n < 10 THEN 0 ELSE mdd END, 6) + 0.0 AS max_drawdown, CASE WHEN n < 10 THEN 0 ELSE du.k END AS max_dd_days, round(CASE WHEN n < 10 OR abs(mdd) < 1e-10 THEN 0 ELSE y / abs(mdd) END, 6) + 0.0 AS calmar, round(CASE WHEN n < 10 THEN 0 ELSE va END, 6) + 0.0 AS var_95, round(CASE WHEN n < 10 THEN 0 ELSE cva END, 6) + 0.0 AS cvar_95,
  round(CASE WHEN n < 20 OR abs(va) < 1e-10 THEN 0 ELSE hi / abs(va) END, 6) + 0.0 AS tail_ratio FROM g JOIN du USING (algo_id)""")
def profile_batch(spark: SparkSession, d: str) -> DataFrame:
    """Ten metrics per algorithm in the profiler's variant: 0 below ten returns, peaks from 1.0, quantiles by index."""
    e = px.enrich(panel(spark, d))
    w = Window.partitionBy("algo_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = e.withColumn("i", F.row_number().over(Window.partitionBy("algo_id").orderBy("ret")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("algo_id"))).withColumn("pk", F.greatest(F.max("p").over(w), F.lit(1.0)))
    x = x.withColumn("isl", F.sum((F.col("p") >= F.col("pk")).cast("int")).over(w))
    under = x.groupBy("algo_id", "isl").agg(F.count_if(F.col("p") < F.col("pk")).alias("k")).groupBy("algo_id").agg(F.max("k").alias("k"))
    at = lambda q: F.floor(F.lit(q) * F.col("n"))
    grown, loss = F.product(1 + F.col("ret")), F.when(F.col("ret") < 0, F.col("ret"))
    g = x.groupBy("algo_id").agg(
        F.max("n").alias("n"), F.when(grown > 0, F.pow(F.when(grown > 0, grown), 252.0 / F.count(F.lit(1))) - 1).otherwise(-1.0).alias("y"), F.stddev_samp("ret").alias("s"), F.avg("ret").alias("m"), F.sqrt(F.avg(loss * loss)).alias("ds"), F.count(loss).alias("losses"), F.min(F.col("p") / F.col("pk") - 1).alias("mdd"),
        F.max(F.when(F.col("i") == at(0.05), F.col("ret"))).alias("va"), F.avg(F.when(F.col("i") < F.greatest(at(0.05), F.lit(1)), F.col("ret"))).alias("cva"), F.max(F.when(F.col("i") == at(0.95), F.col("ret"))).alias("hi"),
    ).join(under, "algo_id")
    root = F.sqrt(F.lit(252.0))
    of = lambda c, ok=F.lit(True): F.when((F.col("n") >= 10) & ok, c).otherwise(0.0)
    per = lambda a, b: a / F.when(b != 0, b)
    s, ds, dd, va = F.col("s"), F.col("ds"), F.abs("mdd"), F.abs("va")
    return g.select(
        "algo_id", of(F.col("y")).alias("ann_return"), of(s * root).alias("ann_vol"), of(per(F.col("m"), s) * root, s >= 1e-10).alias("sharpe"), of(per(F.col("m"), ds) * root, (F.col("losses") >= 2) & (ds >= 1e-10)).alias("sortino"), of(F.col("mdd")).alias("max_drawdown"),
        F.when(F.col("n") >= 10, F.col("k")).otherwise(0).alias("max_dd_days"), of(per(F.col("y"), dd), dd >= 1e-10).alias("calmar"), of(F.col("va")).alias("var_95"), of(F.col("cva")).alias("cvar_95"), of(per(F.col("hi"), va), (F.col("n") >= 20) & (va >= 1e-10)).alias("tail_ratio"),
    )


_FOLDS = f"""{NATION_PRICES}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)), n AS (SELECT count(*) AS n FROM c), k AS (SELECT unnest(generate_series(0, (n - 630) // 126)) AS k FROM n WHERE n >= 630),
tr AS (SELECT k.k, p.algo_id, stddev_samp(p.ret) AS sd FROM k JOIN c ON c.i BETWEEN k.k * 126 AND k.k * 126 + 503 JOIN panel p ON p.date = c.date GROUP BY ALL HAVING stddev_samp(p.ret) > 1e-12),
wt AS (SELECT k, algo_id, 'equal' AS strategy, 1.0 / count(*) OVER (PARTITION BY k) AS w FROM tr UNION ALL SELECT k, algo_id, 'inverse_vol', (1 / sd) / sum(1 / sd) OVER (PARTITION BY k) FROM tr),
dr AS (SELECT wt.strategy, k.k, c.date, coalesce(sum(wt.w * p.ret), 0) AS ret FROM k JOIN c ON c.i BETWEEN k.k * 126 + 504 AND k.k * 126 + 629 JOIN wt ON wt.k = k.k LEFT JOIN panel p ON p.date = c.date AND p.algo_id = wt.algo_id GROUP BY ALL),
fm AS (SELECT strategy, k, CASE WHEN stddev_samp(ret) > 1e-10 THEN avg(ret) / stddev_samp(ret) * {_R} ELSE 0 END AS sh, avg(ret) * 252 AS y FROM dr GROUP BY ALL), st AS (SELECT strategy, count(*) AS folds, avg(sh) AS sh, avg(y) AS y FROM fm GROUP BY strategy)"""


@query(f"WITH {_FOLDS} SELECT strategy, folds, round(sh, 6) + 0.0 AS sharpe_mean, round(y, 6) + 0.0 AS return_mean, row_number() OVER (ORDER BY sh DESC, strategy) AS by_sharpe, row_number() OVER (ORDER BY y DESC, strategy) AS by_return FROM st")
def strategy_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Two strategies with one allocation a fold, held through its test: mean Sharpe and arithmetic annual return over the folds, and both rankings."""
    p = nation_panel(spark, d).select("date", "algo_id", "ret")
    f = bt.folds(p, 504, 126, 126)  # a row a fold
    train = f.select("fold_id", F.explode(F.sequence("train_start", "train_end")).alias("date")).join(p, "date").groupBy("fold_id", "algo_id").agg(F.stddev_samp("ret").alias("sd")).filter("sd > 1e-12")
    by = Window.partitionBy("fold_id")
    w = train.select("fold_id", "algo_id", F.lit("equal").alias("strategy"), (1.0 / F.count(F.lit(1)).over(by)).alias("w")).unionByName(train.select("fold_id", "algo_id", F.lit("inverse_vol").alias("strategy"), ((1 / F.col("sd")) / F.sum(1 / F.col("sd")).over(by)).alias("w")))
    dev = F.stddev_samp("ret")
    m = rl.static_folds(w, p, f).groupBy("strategy", "fold_id").agg(F.when(dev > 1e-10, F.avg("ret") / F.when(dev > 1e-10, dev) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sh"), (F.avg("ret") * 252).alias("y"))
    s = m.groupBy("strategy").agg(F.count(F.lit(1)).alias("folds"), F.avg("sh").alias("sharpe_mean"), F.avg("y").alias("return_mean"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "strategy"))  # noqa: E731 (a row a strategy)
    return s.withColumn("by_sharpe", rank("sharpe_mean")).withColumn("by_return", rank("return_mean"))


@query("""
WITH t AS (SELECT DISTINCT * FROM trim_info), l AS (SELECT algo_id AS asset, unnest(['trim_id', 'file_id', 'original_days', 'alive_days', 'dead_days', 'death_price']) AS "column", unnest([CAST(trim_id AS DOUBLE), CAST(file_id AS DOUBLE), CAST(original_days AS DOUBLE), CAST(alive_days AS DOUBLE), CAST(dead_days AS DOUBLE), death_price]) AS value FROM t)
SELECT "column", asset, count(*) AS n, count(value) AS known, round(sum(value), 4) AS total FROM l GROUP BY ALL""", digits=4)
def sheet_as_rows(spark: SparkSession, d: str) -> DataFrame:
    """The wide trim table as rows of column, asset and value, added up by both."""
    t = table(spark, d, "trim_info").distinct().drop("was_trimmed")
    return rl.sheet_rows(t).groupBy("column", "asset").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.sum("value").alias("total"))


@query(f"""
WITH {PANEL}, e AS (SELECT algo_id, CAST(date_trunc('week', date) AS DATE) AS wk, product(1 + ret) - 1 AS r FROM panel GROUP BY ALL)
SELECT algo_id, count(*) AS episodes, round(avg(r), 8) + 0.0 AS mean_reward, round(stddev_pop(r), 8) AS std_reward, round(max(r), 8) + 0.0 AS max_reward, round(min(r), 8) + 0.0 AS min_reward, round(CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(52) ELSE 0 END, 6) + 0.0 AS sharpe FROM e GROUP BY algo_id""", digits=8)
def episode_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Weeks as episodes: mean, population deviation and extremes of their returns, and a Sharpe ratio of 52 periods."""
    e = panel(spark, d).groupBy("algo_id", F.trunc("date", "week").alias("wk")).agg((F.product(1 + F.col("ret")) - 1).alias("r"))
    dev = F.stddev_samp("r")
    return e.groupBy("algo_id").agg(F.count(F.lit(1)).alias("episodes"), F.avg("r").alias("mean_reward"), F.stddev_pop("r").alias("std_reward"), F.max("r").alias("max_reward"), F.min("r").alias("min_reward"), F.round(F.when(dev > 1e-12, F.avg("r") / F.when(dev > 1e-12, dev) * F.sqrt(F.lit(52.0))).otherwise(0.0), 6).alias("sharpe"))


@query(f"""
WITH {PANEL}, {FAMILIES}, {_PROFILES}, g AS (SELECT family, avg(sh) AS s, count(*) AS n FROM pr JOIN fam USING (algo_id) GROUP BY family HAVING count(*) >= 2), top AS (SELECT family FROM g ORDER BY round(s, 9) DESC, family LIMIT 3)
SELECT {_DAY.format('p.date')} AS date, count(*) AS n, round(avg(p.ret), 8) + 0.0 AS ret FROM panel p WHERE p.algo_id IN (SELECT algo_id FROM fam WHERE family IN (SELECT family FROM top)) GROUP BY p.date""", digits=8)
def cluster_universe(spark: SparkSession, d: str) -> DataFrame:
    """Returns of the algorithms of the three families with the best mean Sharpe (two members at least)."""
    p, f = panel(spark, d), families(spark, d)
    g = _profiles(p).join(f, "algo_id").groupBy("family").agg(F.avg("sh").alias("s"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    top = g.orderBy(F.round("s", 9).desc(), "family").limit(3)
    chosen = f.join(top, "family", "left_semi")
    return p.join(chosen, "algo_id", "left_semi").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("ret"))


def _projections(rounds: int = 10) -> str:
    """The rounds of alternating projections as common table expressions, the last one named done."""
    out = "q0 AS (SELECT date, algo_id, (1 / sd) / sum(1 / sd) OVER (PARTITION BY date) AS w, 1.0 / count(*) OVER (PARTITION BY date) AS cur, false AS dn FROM sel)"
    for i in range(rounds):
        out += f""", a{i} AS (SELECT *, greatest(least(w, 0.12), 0.02) AS c FROM q{i}), b{i} AS (SELECT *, CASE WHEN sum(c) OVER d > 0.95 THEN c * 0.95 / sum(c) OVER d ELSE c END AS e FROM a{i} WINDOW d AS (PARTITION BY date)),
t{i} AS (SELECT *, sum(abs(e - cur)) OVER (PARTITION BY date) / 2 AS t FROM b{i}), n{i} AS (SELECT date, algo_id, w, cur, CASE WHEN dn THEN w WHEN t > 0.04 THEN cur + 0.04 / t * (e - cur) ELSE e END AS nw FROM t{i}),
q{i + 1} AS (SELECT date, algo_id, nw AS w, cur, max(CAST(abs(nw - w) > 1e-8 + 1e-5 * abs(w) AS INT)) OVER (PARTITION BY date) = 0 AS dn FROM n{i})"""
    return out


@query(f"WITH {_FACTORS}, {_projections()} SELECT {_DAY.format('date')} AS date, algo_id, round(w, 8) AS w FROM q10", digits=8)
def constraints_projected(spark: SparkSession, d: str) -> DataFrame:
    x = al.equal(selected(spark, d)).withColumnRenamed("w", "current")
    return al.projected(al.inverse_vol(x, "sd").select("date", "algo_id", "w", "current"), 0.02, 0.12, 0.95, 0.04).select("date", "algo_id", "w")


# Family budgets at each month's first date: the size of the family's mean return; alive: a return on the date itself.
@query(f"""
WITH {PANEL}, {_MONTHS}, {FAMILIES}, al AS (SELECT p.date, f.family, p.algo_id, p.ret FROM panel p JOIN months USING (date) JOIN fam f USING (algo_id)),
fs AS (SELECT DISTINCT family FROM fam), b0 AS (SELECT m.date, fs.family, coalesce(abs(x.r), 0.001) AS w FROM months m CROSS JOIN fs LEFT JOIN (SELECT date, family, avg(ret) AS r FROM al GROUP BY ALL) x ON x.date = m.date AND x.family = fs.family),
b AS (SELECT date, family, CASE WHEN sum(w) OVER d > 1e-8 THEN w / sum(w) OVER d ELSE 1.0 / count(*) OVER d END AS w FROM b0 WINDOW d AS (PARTITION BY date)), n AS (SELECT date, family, count(*) AS n FROM al GROUP BY ALL),
h AS (SELECT b.date, b.family, n.n, CASE WHEN sum(b.w) OVER (PARTITION BY b.date) > 1e-8 THEN b.w / sum(b.w) OVER (PARTITION BY b.date) ELSE b.w END AS w FROM b JOIN n ON n.date = b.date AND n.family = b.family)
SELECT {_DAY.format('al.date')} AS date, al.algo_id, round(h.w / h.n, 8) AS w FROM al JOIN h ON h.date = al.date AND h.family = al.family""", digits=8)
def family_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Family budgets as weights of the algorithms alive, at each month's first date."""
    p, f = panel(spark, d), families(spark, d)
    months = _months(p)
    alive = p.join(months, "date").join(f, "algo_id").select("date", "family", "algo_id", "ret")
    labels = f.agg(F.collect_set("family").alias("labels"))  # the few families
    every = with_single(months, labels).select("date", F.explode("labels").alias("family"))
    size = every.join(alive.groupBy("date", "family").agg(F.avg("ret").alias("r")), ["date", "family"], "left").select("date", "family", F.coalesce(F.abs("r"), F.lit(0.001)).alias("w"))
    return al.decoded(size, alive.drop("ret"))


@query(digits=6)
def regimes_of_states(spark: SparkSession, d: str) -> DataFrame:
    """The hidden Markov states of the market and the regime each is given."""
    from ..operators import cluster as cl
    from ..operators import regimes as rg

    x = rg.inputs(market(spark, d).select("date", "ret"))
    states = cl.hidden_markov(x, ["vol", "trend", "momentum"], 4).join(x, "date")
    return cl.states_to_regimes(states.select("state", "trend", "vol", "momentum"))


@query(digits=6)
def feature_loadings(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster as cl
    from .inference_queries import _features

    f, names = _features(spark, d)
    return cl.loadings(f, names)


@query(digits=4)
def clusters_by_count(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster as cl
    from .inference_queries import _features

    f, names = _features(spark, d)
    return cl.by_count(f, "algo_id", names, range(2, 7))


@query()
def clusters_two_layers(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import cluster as cl
    from .inference_queries import _features

    f, names = _features(spark, d)
    return cl.two_layers(f, "algo_id", names[:2], names[2:], 3, 2)


@query(f"""
WITH {NATION_PRICES}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM panel)), k AS (SELECT DISTINCT algo_id FROM panel), g AS (SELECT k.algo_id, c.date, c.i, p.ret AS r FROM k CROSS JOIN c LEFT JOIN panel p ON p.algo_id = k.algo_id AND p.date = c.date),
j AS (SELECT a.algo_id AS a, b.algo_id AS b, a.i, a.date, CASE WHEN b.r IS NOT NULL THEN a.r END AS x, CASE WHEN a.r IS NOT NULL THEN b.r END AS y FROM g a JOIN g b ON a.i = b.i AND a.algo_id < b.algo_id),
w AS (SELECT a, b, i, date, count(x) OVER v AS n, corr(x, y) OVER v AS r FROM j WINDOW v AS (PARTITION BY a, b ORDER BY i ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING))
SELECT {_DAY.format('date')} AS date, round(avg(r), 6) + 0.0 AS mean_corr, count(*) AS pairs FROM w WHERE i > 42 AND n >= 5 AND isfinite(r) GROUP BY date""")
def mean_rolling_corr_before(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of all pairs over the 42 dates before each date, the date itself left out."""
    from ..operators import pairs as pr

    return pr.mean_correlation(nation_panel(spark, d), 50, 42, including=False)


@query(f"""
WITH {_WEEKLY}, v AS (SELECT * FROM lab WHERE lower(trim(label)) NOT IN ('', 'inactive', 'insufficient_data', 'error'))
SELECT algo_id, {_DAY.format('week_end')} AS week_end, label FROM v WHERE week_end = (SELECT max(week_end) FROM v)""")
def labels_of_latest_week(spark: SparkSession, d: str) -> DataFrame:
    """The valid labels of the latest week that has any."""
    lab = weekly_labels(spark, d).filter(~F.lower(F.trim("label")).isin("", "inactive", "insufficient_data", "error"))
    return with_single(lab, lab.agg(F.max("week_end").alias("z"))).filter("week_end = z").select("algo_id", "week_end", "label")


@query(f"""
WITH {PANEL}, {FAMILIES}, {_PROFILES}, m AS (SELECT family, quantile_cont(sh, 0.5) AS score, count(*) AS n FROM pr JOIN fam USING (algo_id) GROUP BY family), k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, family) AS r FROM m)
SELECT family, round(score, 6) + 0.0 AS score, n, score >= 1.0 AS beyond, score >= 1.0 OR r <= 3 AS kept FROM k""")
def families_covered(spark: SparkSession, d: str) -> DataFrame:
    """Families with a median Sharpe of at least 1, and the three best ones in any case."""
    m = _profiles(panel(spark, d)).join(families(spark, d), "algo_id").groupBy("family").agg(F.expr("percentile(sh, 0.5)").alias("score"), F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "family"))  # a row a family
    return m.withColumn("r", r).select("family", "score", "n", (F.col("score") >= 1.0).alias("beyond"), ((F.col("score") >= 1.0) | (F.col("r") <= 3)).alias("kept"))


@query(f"""
WITH {NATION_PRICES}, {NATION_TRADES}, n AS (SELECT algo_id, count(*) AS k FROM panel GROUP BY algo_id), t AS (SELECT algo_id, count(*) AS n, avg(day_close - day_open) AS a, quantile_cont(day_close - day_open, 0.5) AS m FROM clean GROUP BY algo_id)
SELECT algo_id, n AS trades, round(n / (k / 21.0), 6) AS trades_per_month, round(a, 6) AS mean_days, round(m, 6) AS median_days FROM t JOIN n USING (algo_id)""")
def trades_per_month_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Trades per 21 rows of returns, mean and median duration in whole days."""
    days = F.datediff("day_close", "day_open")
    t = nation_trades(spark, d).withColumn("days", days).groupBy("algo_id").agg(F.count(F.lit(1)).alias("trades"), F.avg("days").alias("mean_days"), F.expr("percentile(days, 0.5)").alias("median_days"))
    n = nation_panel(spark, d).groupBy("algo_id").agg(F.count(F.lit(1)).alias("k"))
    return t.join(n, "algo_id").select("algo_id", "trades", (F.col("trades") / (F.col("k") / 21.0)).alias("trades_per_month"), "mean_days", "median_days")
