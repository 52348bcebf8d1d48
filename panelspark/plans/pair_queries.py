"""Queries on pairs in the variants of the reference's kernels, and on what algorithms trade, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comovement as cm
from ..operators import inference as inf
from ..operators import pairs as pr
from ..sources.tables import one_per_key, table
from .base import NATION_PRICES, Registry, nation_panel, nation_prices
from .inference_queries import _SCREEN, _sides

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"""
WITH {NATION_PRICES}, m AS (SELECT algo_id, avg(ret) AS m FROM panel GROUP BY algo_id), x AS (SELECT p.algo_id, p.date, p.ret - m.m AS e FROM panel p JOIN m USING (algo_id))
SELECT a.algo_id AS a, b.algo_id AS b, round(CASE WHEN count(*) > 2 AND sum(a.e * a.e) > 1e-10 AND sum(b.e * b.e) > 1e-10 THEN sum(a.e * b.e) / sqrt(sum(a.e * a.e) * sum(b.e * b.e)) ELSE 0 END, 6) + 0.0 AS corr, count(*) AS n FROM x a JOIN x b ON a.date = b.date AND a.algo_id < b.algo_id GROUP BY ALL""")
def corr_own_means(spark: SparkSession, d: str) -> DataFrame:
    return cm.correlations_own_means(nation_panel(spark, d))


@query(f"""
WITH {NATION_PRICES}, k AS (SELECT DISTINCT algo_id FROM panel), c AS (SELECT DISTINCT date FROM panel), g AS (SELECT k.algo_id, c.date, coalesce(p.ret, 0) AS r FROM k CROSS JOIN c LEFT JOIN panel p ON p.algo_id = k.algo_id AND p.date = c.date),
v AS (SELECT a.algo_id AS a, b.algo_id AS b, covar_samp(a.r, b.r) AS c FROM g a JOIN g b ON a.date = b.date AND a.algo_id <= b.algo_id GROUP BY ALL), t AS (SELECT avg(c) AS t FROM v WHERE a = b)
SELECT a, b, round(0.9 * c + CASE WHEN a = b THEN 0.1 * t ELSE 0 END, 6) + 0.0 AS cov FROM v, t""")
def cov_shrunk(spark: SparkSession, d: str) -> DataFrame:
    return cm.shrunk_covariance(nation_panel(spark, d))


_GRID = f"{NATION_PRICES}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM panel)), k AS (SELECT DISTINCT algo_id FROM panel), g AS (SELECT k.algo_id, c.date, c.i, p.ret AS r FROM k CROSS JOIN c LEFT JOIN panel p ON p.algo_id = k.algo_id AND p.date = c.date)"


@query(f"""
WITH {_GRID}, j AS (SELECT a.algo_id AS a, b.algo_id AS b, a.i, CASE WHEN b.r IS NOT NULL THEN a.r END AS x, CASE WHEN a.r IS NOT NULL THEN b.r END AS y FROM g a JOIN g b ON a.date = b.date AND a.algo_id < b.algo_id),
w AS (SELECT a, b, i, count(x) OVER v AS n, corr(x, y) OVER v AS r FROM j WINDOW v AS (PARTITION BY a, b ORDER BY i ROWS 62 PRECEDING)), o AS (SELECT a, b, r FROM w WHERE i >= 63 AND n >= 5 AND isfinite(r))
SELECT a, b, count(*) AS n, round(avg(r), 6) + 0.0 AS mean_corr, round(stddev_samp(r), 6) AS std_corr, round(min(r), 6) + 0.0 AS min_corr, round(max(r), 6) + 0.0 AS max_corr, round(max(r) - min(r), 6) AS range_corr FROM o GROUP BY a, b HAVING count(*) >= 10""")
def corr_stability(spark: SparkSession, d: str) -> DataFrame:
    return cm.correlation_stability(nation_panel(spark, d))


@query(f"""
WITH {_GRID}, o AS (SELECT algo_id, i, r, avg(r) OVER v AS m, CASE WHEN count(r) OVER v > 1 THEN stddev_samp(r) OVER v ELSE 0 END AS sd FROM g WINDOW v AS (PARTITION BY algo_id ORDER BY i ROWS 62 PRECEDING)),
j AS (SELECT a.algo_id AS a, b.algo_id AS b, a.i, a.m AS ma, b.m AS mb, CASE WHEN b.r IS NOT NULL THEN a.r END AS x, CASE WHEN a.r IS NOT NULL THEN b.r END AS y FROM o a JOIN o b ON a.i = b.i AND a.algo_id <= b.algo_id),
s AS (SELECT a, b, i, ma, mb, count(x) OVER v AS n, sum(x * y) OVER v AS sxy, sum(x) OVER v AS sx, sum(y) OVER v AS sy FROM j WINDOW v AS (PARTITION BY a, b ORDER BY i ROWS 62 PRECEDING)),
t AS (SELECT i, sum(CASE WHEN a = b THEN 1 ELSE 2 END * CASE WHEN n > 0 THEN (sxy - ma * sy - mb * sx + n * ma * mb) / greatest(n - 1, 1) ELSE 0 END) AS cv FROM s GROUP BY i), z AS (SELECT i, sum(sd) AS sd, count(*) AS k FROM o GROUP BY i)
SELECT strftime(c.date, '%Y-%m-%d') AS date, round(CASE WHEN z.k >= 2 AND sqrt(greatest(t.cv, 0)) / z.k >= 1e-10 THEN z.sd / sqrt(t.cv) ELSE 1 END, 6) AS ratio FROM c JOIN t USING (i) JOIN z USING (i) WHERE c.i >= 63""")
def diversification_rolling(spark: SparkSession, d: str) -> DataFrame:
    return cm.rolling_diversification(nation_panel(spark, d))


@query(f"""
WITH {NATION_PRICES}, pc AS (SELECT a.algo_id AS a, b.algo_id AS b, corr(a.ret, b.ret) AS corr FROM panel a JOIN panel b ON a.date = b.date AND a.algo_id < b.algo_id GROUP BY ALL HAVING count(*) >= 30 AND isfinite(corr(a.ret, b.ret))),
q AS (SELECT a, b FROM pc ORDER BY round(abs(corr), 9) DESC, a, b LIMIT 500), j AS (SELECT q.a, q.b, x.date, x.close AS y, z.close AS x FROM q JOIN px x ON x.algo_id = q.a JOIN px z ON z.algo_id = q.b AND z.date = x.date),
f AS (SELECT a, b, covar_samp(y, x) / var_pop(x) AS h, avg(y) AS my, avg(x) AS mx, count(*) AS n FROM j GROUP BY ALL HAVING count(*) >= 60),
e AS (SELECT j.a, j.b, j.date, f.h, f.n, y - (my - f.h * mx) - f.h * x AS e FROM j JOIN f ON f.a = j.a AND f.b = j.b), l AS (SELECT *, lag(e) OVER (PARTITION BY a, b ORDER BY date) AS lg FROM e),
p AS (SELECT a, b, regr_slope(e - lg, lg) * count(lg) / (count(lg) - 1) AS phi, stddev_pop(lg) AS sl, count(lg) AS m FROM l GROUP BY ALL),
r AS (SELECT l.a, l.b, any_value(h) AS h, any_value(n) AS n, any_value(phi) AS phi, any_value(sl) AS sl, any_value(m) AS m, stddev_pop(e - lg - phi * lg) AS s, avg(e) AS me, stddev_pop(e) AS se, arg_max(e, date) AS le FROM l JOIN p ON p.a = l.a AND p.b = l.b WHERE sl >= 1e-10 GROUP BY ALL),
t AS (SELECT *, phi / (s / (sl * sqrt(m))) AS t FROM r)
SELECT a, b, round(t, 4) + 0.0 AS adf_stat, t < -3.34 AS is_cointegrated_5pct, t < -3.04 AS is_cointegrated_10pct, round(h, 4) + 0.0 AS hedge_ratio, round(CASE WHEN phi < 0 THEN least(-ln(2) / phi, 9999) ELSE 9999 END, 4) AS half_life_days, round(me, 4) + 0.0 AS spread_mean, round(se, 4) AS spread_std, round((le - me) / se, 4) + 0.0 AS current_z_score, n AS n_days FROM t""", digits=4)
def cointegration_by_residuals(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most correlated pairs: the reference's number of tests."""
    best = pr.correlations(nation_panel(spark, d)).filter("corr IS NOT NULL").orderBy(F.round(F.abs("corr"), 9).desc(), "a", "b").limit(500)
    return cm.cointegration_residuals(nation_prices(spark, d), best)


#: Candidates of an algorithm for the deep signals, as in the reference.
_DEEP_CANDIDATES = 10
_DEEP = f"""{_SCREEN}, k AS (SELECT a, b FROM sr WHERE rank <= 10), j AS (SELECT k.a, k.b, p.date, p.ret AS x, c.y, count(*) OVER (PARTITION BY k.a, k.b) AS n FROM k JOIN panel p ON p.algo_id = k.a JOIN cand c ON c.b = k.b AND c.date = p.date),
u AS (SELECT *, CAST(least(20, n // 3) AS INT) AS wd, row_number() OVER w AS rn, product(1 + x) OVER w AS px, product(1 + y) OVER w AS py, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM j WHERE n >= 20 WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, px / nullif(max(px) OVER w, 0) - 1 AS dx, py / nullif(max(py) OVER w, 0) - 1 AS dy, CASE WHEN rn >= wd THEN stddev_samp(x) OVER (PARTITION BY a, b ORDER BY date ROWS BETWEEN wd - 1 PRECEDING AND CURRENT ROW) END AS vx, CASE WHEN rn >= wd THEN stddev_samp(y) OVER (PARTITION BY a, b ORDER BY date ROWS BETWEEN wd - 1 PRECEDING AND CURRENT ROW) END AS vy FROM u WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS UNBOUNDED PRECEDING)),
s0 AS (SELECT a, b, count(*) AS n, corr(x, y) AS pe, corr(rx, ry) AS sp, CASE WHEN var_pop(y) > 1e-10 THEN covar_samp(x, y) / var_pop(y) ELSE 0 END AS be, corr(dx, dy) AS dd, corr(vx, vy) AS vo, avg(CAST(sign(x) = sign(y) AS INT)) AS ag FROM v GROUP BY a, b),
s AS (SELECT a, b, n, CASE WHEN isfinite(pe) THEN pe ELSE 0 END AS pe, CASE WHEN isfinite(sp) THEN sp ELSE 0 END AS sp, be, CASE WHEN isfinite(dd) THEN dd ELSE 0 END AS dd, CASE WHEN isfinite(vo) THEN vo ELSE 0 END AS vo, ag FROM s0)"""


@query(f"""
WITH {_DEEP}
SELECT a, b, n AS n_overlap, round(pe, 5) + 0.0 AS pearson_r, round(sp, 5) + 0.0 AS spearman_r, round(be, 5) + 0.0 AS beta, round(dd, 5) + 0.0 AS dd_corr, round(vo, 5) + 0.0 AS vol_regime_corr, round(ag, 5) AS directional_agreement,
  round(0.25 * abs(pe) + 0.15 * abs(sp) + 0.1 * least(abs(be), 2) + 0.15 * greatest(dd, 0) + 0.15 * greatest(vo, 0) + 0.1 * ag, 5) AS composite_score FROM s""", digits=5)
def asset_signals_deep(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return inf.deep_signals(pr.screen(a, b, _DEEP_CANDIDATES), a, b)


def _inferred(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    classes = one_per_key(table(spark, d, "price_files").select(F.col("file_id").cast("string").alias("b"), F.col("sessions").alias("asset_class")), ["b"])
    return inf.infer(inf.deep_signals(pr.screen(a, b, _DEEP_CANDIDATES), a, b), classes, a, b)


@query(digits=4)
def asset_inference(spark: SparkSession, d: str) -> DataFrame:
    """What each algorithm trades; the class of a price file is its sessions. The p-values are beyond SQL: tested against brute force."""
    return _inferred(spark, d)


@query(digits=4)
def asset_priors(spark: SparkSession, d: str) -> DataFrame:
    return inf.priors(_inferred(spark, d))


@query(digits=4)
def style_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Each algorithm by its (up to) three strongest candidates; a constrained least-squares fit, tested by its optimality conditions."""
    a, b = _sides(spark, d)
    return cm.style_regression(a, b, pr.screen(a, b, 3))
