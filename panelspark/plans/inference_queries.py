"""Queries on sources and sets, screens of candidates, labels and clusters, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import metrics as mx
from ..operators import pairs as pr
from ..operators import panel as px
from ..operators import regimes as rg
from ..sources import files
from ..sources.tables import table
from .base import BARS, CLEAN, FAMILIES, MARKET, NATION_PRICES, PANEL, TRADES, Registry, bars, families, market, nation_panel, panel, trades

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT file_id, count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days FROM ohlc GROUP BY file_id")
def source_inspect(spark: SparkSession, d: str) -> DataFrame:
    return files.inspect(table(spark, d, "ohlc"), "file_id", "ts")


@query(f"WITH {TRADES}, m AS (SELECT algo_id, avg(invested) AS v FROM t WHERE algo_id IS NOT NULL GROUP BY algo_id ORDER BY v DESC NULLS LAST, algo_id LIMIT 5) SELECT t.algo_id, count(*) AS n FROM t JOIN m USING (algo_id) GROUP BY t.algo_id")
def top_symbols(spark: SparkSession, d: str) -> DataFrame:
    t = files.top_by_mean(trades(spark, d).filter("algo_id IS NOT NULL"), "algo_id", "invested", 5)
    return t.groupBy("algo_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT DISTINCT stamp_id, regexp_extract(file_name, '^([A-Z0-9]+)_', 1) AS symbol, close, line_no FROM stamps WHERE feed = 'futures'),
x AS (SELECT CASE WHEN regexp_matches(symbol, '^[A-Z0-9]{2,4}?[FGHJKMNQUVXZ][0-9]{1,2}$') THEN regexp_extract(symbol, '^([A-Z0-9]{2,4}?)([FGHJKMNQUVXZ])([0-9]{1,2})$', 1) END AS root, line_no // 10 AS slot, symbol, close, line_no, stamp_id FROM s)
SELECT root, slot, arg_max(symbol, (line_no, symbol, stamp_id)) AS symbol, round(arg_max(close, (line_no, symbol, stamp_id)), 6) AS close FROM x WHERE root IS NOT NULL AND close > 0 GROUP BY root, slot""")
def futures_front(spark: SparkSession, d: str) -> DataFrame:
    """Per root and slot the leading contract; ten lines stand for a trading date, the line number for its volume."""
    s = table(spark, d, "stamps").filter("feed = 'futures'").select("stamp_id", F.regexp_extract("file_name", "^([A-Z0-9]+)_", 1).alias("symbol"), "close", "line_no").distinct()
    s = s.withColumn("slot", F.floor(F.col("line_no") / 10)).withColumn("volume", F.struct("line_no", "symbol", "stamp_id"))
    return files.front_contracts(s, "symbol", "slot", "close", "volume")


@query("SELECT algo_id, EXISTS (SELECT 1 FROM price_files p WHERE p.algo_id = t.algo_id) AS has_file FROM (SELECT DISTINCT algo_id FROM trades WHERE algo_id IS NOT NULL) t")
def products_missing(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trades").filter("algo_id IS NOT NULL").select("algo_id").distinct()
    p = table(spark, d, "price_files").select("algo_id").distinct()
    return t.join(p, "algo_id", "left_semi").withColumn("has_file", F.lit(True)).unionByName(t.join(p, "algo_id", "left_anti").withColumn("has_file", F.lit(False)))


@query(f"""
WITH {PANEL}, {BARS}, a AS (SELECT DISTINCT date FROM panel), b AS (SELECT DISTINCT date FROM bars)
SELECT date, 'both' AS side FROM (SELECT date FROM a INTERSECT SELECT date FROM b) UNION ALL SELECT date, 'panel' FROM (SELECT date FROM a EXCEPT SELECT date FROM b) UNION ALL SELECT date, 'bars' FROM (SELECT date FROM b EXCEPT SELECT date FROM a)""")
def calendar_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = panel(spark, d).select("date"), bars(spark, d).select("date")
    side = lambda x, n: x.select("date", F.lit(n).alias("side"))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "panel")).unionByName(side(b.subtract(a), "bars"))


@query(f"WITH {CLEAN} SELECT isodow(day_open) - 1 AS weekday, count(*) AS n, round(avg(volume), 8) AS mean_volume FROM clean GROUP BY ALL", digits=8)
def weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    from .benchmark_queries import clean

    return clean(spark, d).groupBy(F.weekday("day_open").cast("long").alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("mean_volume"))


@query(f"""
WITH {PANEL}, m AS (SELECT algo_id, avg(ret) AS mean, stddev_samp(ret) AS std, min(ret) AS low, max(ret) AS high FROM panel GROUP BY algo_id), u AS (UNPIVOT m ON mean, std, low, high INTO NAME metric VALUE value)
SELECT algo_id, metric, round(value, 10) + 0.0 AS value FROM u""", digits=10)
def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    m = panel(spark, d).groupBy("algo_id").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.min("ret").alias("low"), F.max("ret").alias("high"))
    return m.unpivot("algo_id", ["mean", "std", "low", "high"], "metric", "value")


@query(f"WITH {PANEL}, {FAMILIES} SELECT p.date, f.family, round(avg(p.ret), 10) + 0.0 AS ret FROM panel p LEFT JOIN fam f USING (algo_id) GROUP BY p.date, f.family", digits=10)
def observation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """(date, family, ret): every family found, in rows; algorithms without a family as null."""
    j = panel(spark, d).join(families(spark, d), "algo_id", "left")
    return j.groupBy("date", "family").agg(F.avg("ret").alias("ret"))


@query(f"""
WITH {PANEL}, {FAMILIES}, s AS (SELECT algo_id, avg(ret) AS m, CASE WHEN stddev_samp(ret) > 1e-10 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sh FROM panel GROUP BY algo_id),
g AS (SELECT f.family, count(*) AS n, avg(sh) AS sharpe, avg(m) AS mean_ret FROM s JOIN fam f USING (algo_id) WHERE f.family NOT IN ('unknown', 'none', '') GROUP BY f.family HAVING count(*) >= 2)
SELECT family, n, round(sharpe, 6) + 0.0 AS sharpe, round(mean_ret, 10) + 0.0 AS mean_ret FROM g ORDER BY round(sharpe, 9) DESC, family LIMIT 3""", digits=10)
def family_selection(spark: SparkSession, d: str) -> DataFrame:
    s = panel(spark, d).groupBy("algo_id").agg(F.avg("ret").alias("m"), mx.sharpe().alias("sh"))
    valid = ~F.lower(F.trim("family")).isin("unknown", "none", "")
    g = s.join(families(spark, d).filter(valid), "algo_id").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg("sh").alias("sharpe"), F.avg("m").alias("mean_ret")).filter("n >= 2")
    return g.orderBy(F.round("sharpe", 9).desc(), "family").limit(3).withColumn("sharpe", F.round("sharpe", 6))


@query(f"""
WITH {PANEL}, w AS (SELECT date, algo_id, ret FROM panel), z AS (SELECT date, avg(ret) AS ret FROM (SELECT date, ret FROM w WHERE algo_id < 'M' UNION ALL SELECT date, ret FROM w WHERE algo_id >= 'M') GROUP BY date)
SELECT date, round(ret, 10) + 0.0 AS ret FROM z""", digits=10)
def stitched_average(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of the panel put together, dates of both averaged."""
    p = panel(spark, d).select("date", "ret", "algo_id")
    both = p.filter("algo_id < 'M'").drop("algo_id").unionByName(p.filter("algo_id >= 'M'").drop("algo_id"))
    return both.groupBy("date").agg(F.avg("ret").alias("ret"))


# Candidates: daily returns of the price files; screened for each algorithm of the panel.
_CANDIDATES = f"{PANEL}, {BARS}, cand AS (SELECT CAST(file_id AS VARCHAR) AS b, date, close / lag(close) OVER (PARTITION BY file_id ORDER BY date) - 1 AS y FROM bars QUALIFY y IS NOT NULL AND abs(y) < 0.5)"
_SCREEN = (
    _CANDIDATES
    + """, sc AS (SELECT p.algo_id AS a, c.b, round(corr(p.ret, c.y), 9) AS corr, count(*) AS n FROM panel p JOIN cand c USING (date) GROUP BY ALL HAVING count(*) >= 20 AND var_pop(p.ret) > 1e-18 AND var_pop(c.y) > 1e-18),
sr AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(corr) DESC, b) AS rank FROM sc)"""
)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = panel(spark, d).select(F.col("algo_id").alias("k"), "date", F.col("ret").alias("v"))
    b = px.simple_returns(bars(spark, d).select(F.col("file_id").cast("string").alias("k"), "date", "close"), "k").filter("ret IS NOT NULL AND abs(ret) < 0.5").select("k", "date", F.col("ret").alias("v"))
    return a, b


@query(f"WITH {_SCREEN} SELECT a, b, round(corr, 6) + 0.0 AS corr, n, rank FROM sr WHERE rank <= 5")
def asset_screen(spark: SparkSession, d: str) -> DataFrame:
    return pr.screen(*_sides(spark, d), 5)


@query(f"""
WITH {_SCREEN}, k AS (SELECT a, b FROM sr WHERE rank <= 2), j AS (SELECT k.a, k.b, p.ret AS x, c.y FROM k JOIN panel p ON p.algo_id = k.a JOIN cand c ON c.b = k.b AND c.date = p.date),
r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM j)
SELECT a, b, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(covar_samp(x, y) / var_pop(y), 6) + 0.0 AS beta, round(avg(CAST(sign(x) = sign(y) AS INT)) FILTER (x <> 0 AND y <> 0), 6) AS agreement, count(*) AS n FROM r GROUP BY a, b""")
def asset_signals(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return pr.signals(pr.screen(a, b, 2), a, b)


@query()
def asset_label(spark: SparkSession, d: str) -> DataFrame:
    """Per algorithm its best candidate with the p-value of the correlation and the label it earns: strong below 0.05, weak below 0.10."""
    s = pr.with_p_value(pr.screen(*_sides(spark, d), 1))
    label = F.when(F.col("p_value") < 0.05, "strong").when(F.col("p_value") < 0.10, "weak").otherwise("none")
    return s.select("a", "b", "corr", "n", "p_value", label.alias("label"), F.when(F.col("corr") < 0, "inverse").otherwise("direct").alias("direction"))


@query(f"""
WITH {NATION_PRICES}, top AS (SELECT algo_id FROM panel GROUP BY algo_id ORDER BY count(*) DESC, algo_id LIMIT 100), pt AS (SELECT p.* FROM panel p JOIN top USING (algo_id))
SELECT a.algo_id AS a, b.algo_id AS b, round(covar_samp(a.ret, b.ret), 6) + 0.0 AS cov, round(0.9 * covar_samp(a.ret, b.ret), 6) + 0.0 AS shrunk, count(*) AS n FROM pt a JOIN pt b ON a.date = b.date AND a.algo_id < b.algo_id GROUP BY ALL HAVING count(*) > 1""")
def cov_matrix_pairs(spark: SparkSession, d: str, top: int = 100) -> DataFrame:
    m = pr.moments(nation_panel(spark, d), top=top).filter("n > 1")
    cov = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)
    return m.select("a", "b", cov.alias("cov"), (0.9 * cov).alias("shrunk"), F.col("n").cast("long").alias("n"))


@query()
def rolling_pca_share(spark: SparkSession, d: str) -> DataFrame:
    dense = px.densify(nation_panel(spark, d), "algo_id", "ret", F.lit(0.0))
    return pr.first_component_share(dense, 50, 42)


@query("""
WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM x GROUP BY label),
d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(pow(list_distance(a.v, b.v), 2)) AS s, any_value(n.n) AS n FROM x a, x b JOIN n ON n.label = b.label GROUP BY ALL),
m AS (SELECT vec_id, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY vec_id),
e AS (SELECT vec_id, label, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM x), c AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT i, avg(v) AS m FROM e GROUP BY i),
w AS (SELECT e.label, sum(pow(e.v - c.m, 2)) AS w FROM e JOIN c USING (label, i) GROUP BY e.label), b AS (SELECT sum(c.n * pow(c.m - g.m, 2)) AS b FROM c JOIN g USING (i)), r AS (SELECT label, sqrt(w / n) AS r FROM w JOIN n USING (label)),
dc AS (SELECT a.label AS la, z.label AS lb, sqrt(sum(pow(a.m - z.m, 2))) AS d FROM c a JOIN c z ON a.i = z.i AND a.label <> z.label GROUP BY ALL), db AS (SELECT dc.la, max((p.r + q.r) / dc.d) AS v FROM dc JOIN r p ON p.label = dc.la JOIN r q ON q.label = dc.lb GROUP BY dc.la),
t AS (SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM n) AS k)
SELECT t.n, t.k, round((SELECT b FROM b) / (t.k - 1) / ((SELECT sum(w) FROM w) / (t.n - t.k)), 4) AS calinski_harabasz, round((SELECT avg(v) FROM db), 4) AS davies_bouldin, round((SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FROM m), 4) + 0.0 AS silhouette FROM t""", digits=4)
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{i}" for i in range(size)]
    return cl.quality(e.select("label", *(F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(names))), names)


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    s = mx.summary(px.enrich(panel(spark, d)))
    names = ["ann_vol", "sharpe", "max_drawdown", "win_rate"]
    return cl.vectors(s, "algo_id", names), names


@query()
def clusters_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cl.kmeans(*((x := _features(spark, d))[0], "algo_id", x[1], 4))


@query()
def clusters_mixture(spark: SparkSession, d: str) -> DataFrame:
    return cl.mixture(*((x := _features(spark, d))[0], "algo_id", x[1], 3))


@query()
def clusters_ward(spark: SparkSession, d: str) -> DataFrame:
    return cl.agglomerate(*((x := _features(spark, d))[0], "algo_id", x[1], 4))


@query()
def clusters_density(spark: SparkSession, d: str) -> DataFrame:
    return cl.density(*((x := _features(spark, d))[0], "algo_id", x[1], 1.5, 3))


@query()
def feature_components(spark: SparkSession, d: str) -> DataFrame:
    f, names = _features(spark, d)
    return cl.principal(f, "algo_id", names)


@query()
def weekly_clusters(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_add(F.trunc(F.date_add("date", 2), "week"), 4)
    w = nation_panel(spark, d).groupBy("algo_id", week.alias("week_end")).agg(F.avg("ret").alias("m"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("s"))
    return cl.weekly_clusters(w, ["m", "s"])


@query()
def regime_hmm(spark: SparkSession, d: str) -> DataFrame:
    """Hidden Markov states of the market from volatility, trend and momentum."""
    x = rg.inputs(market(spark, d).select("date", "ret"))
    return cl.hidden_markov(x, ["vol", "trend", "momentum"], 4)


@query(f"""
WITH {MARKET}, h AS (SELECT date, ret, CASE WHEN ret > 0.01 THEN 'up' WHEN ret < -0.01 THEN 'down' ELSE 'flat' END AS a, CASE WHEN avg(ret) OVER w5 > 0.01 THEN 'up' WHEN avg(ret) OVER w5 < -0.01 THEN 'down' ELSE 'flat' END AS b FROM market WINDOW w5 AS (ORDER BY date ROWS 4 PRECEDING))
SELECT a, b, count(*) AS n FROM h GROUP BY a, b""")
def label_crosstab(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(-4, 0)
    label = lambda c: F.when(c > 0.01, "up").when(c < -0.01, "down").otherwise("flat")
    m = market(spark, d)
    return m.select(label(F.col("ret")).alias("a"), label(F.avg("ret").over(w)).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
