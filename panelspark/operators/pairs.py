"""Correlation of pairs, diversification, co-movement, cointegration.

Pairs come from block Gram matrices, not from a self join: the panel's dates are cut into blocks, each block is one
dense matrix dates x entities, and its cross products are added up over the blocks. The entities are the `top` with
the most rows (a parameter of the feature: the number of pairs grows with its square).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from ..sources.tables import with_single


def busiest(panel: DataFrame, top: int, key: str = "algo_id") -> DataFrame:
    """(key): the `top` entities with the most rows, ties by key."""
    return panel.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key).limit(top).select(key)


def moments(panel: DataFrame, top: int = 100, key: str = "algo_id", value: str = "ret", block_days: int = 256, by: str | None = None) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab), a < b: sums over the days both have a value, also by the label `by`.

    Null values are no values. A pair without a common day has no row.
    """
    few = busiest(panel, top, key)  # at most `top` rows
    extra = [by] if by else []
    x = panel.join(F.broadcast(few), key).filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col("date").alias("d"), F.col(value).alias("v"), *extra)
    x = x.withColumn("block", F.floor(F.unix_date("d") / block_days))
    columns = ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"]

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="d", columns="k", values="v", aggfunc="first")
        names, v = m.columns.to_numpy(), m.to_numpy(float)
        has = ~np.isnan(v)
        z, h = np.where(has, v, 0.0), has.astype(float)
        n, s, q, c = h.T @ h, z.T @ h, (z * z).T @ h, z.T @ z
        i, j = np.triu_indices(len(names), 1)
        keep = n[i, j] > 0
        i, j = i[keep], j[keep]
        out = pd.DataFrame({"a": names[i], "b": names[j], "n": n[i, j], "sa": s[i, j], "sb": s[j, i], "saa": q[i, j], "sbb": q[j, i], "sab": c[i, j]}, columns=columns)
        if by:
            out[by] = pdf[by].iloc[0]
        return out

    schema = "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double" + (f", {by} string" if by else "")
    parts = x.groupBy("block", *extra).applyInPandas(gram, schema)
    return parts.groupBy("a", "b", *extra).agg(*(F.sum(c).alias(c) for c in columns[2:]))


def corr_column() -> Column:
    """Pearson correlation from the moments; null where one side does not vary."""
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    ok = (va > 1e-18) & (vb > 1e-18)
    return F.when(ok, cov / F.sqrt(F.when(ok, va * vb)))


def correlations(panel: DataFrame, top: int = 100, least: int = 30, by: str | None = None) -> DataFrame:
    """(a, b, corr, n) of pairs with at least `least` common days."""
    extra = [by] if by else []
    m = moments(panel, top, by=by).filter(F.col("n") >= least)
    return m.select("a", "b", *extra, corr_column().alias("corr"), F.col("n").cast("long").alias("n"))


def both_directions(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")]))


def best_diversifiers(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, corr, rank): per entity the k least correlated others."""
    w = Window.partitionBy("a").orderBy("corr", "b")
    return both_directions(pairs.filter("corr IS NOT NULL")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("a", "b", "corr", "rank")


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, corr): the k highest, k lowest and k strongest correlations, each pair once."""
    p = pairs.filter("corr IS NOT NULL").select("a", "b", "corr")
    best = [p.orderBy(c, "a", "b").limit(k) for c in (F.col("corr").desc(), F.col("corr").asc(), F.abs("corr").desc())]
    return best[0].unionByName(best[1]).unionByName(best[2]).distinct()


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal-width bins from the least to the greatest value, the last one closed."""
    lim = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = with_single(df.filter(F.col(value).isNotNull()), lim)
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))
    return x.groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rolling_correlation(panel: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """(date, corr) of two entities over their last n common days."""
    x = panel.filter(F.col("algo_id") == a).select("date", F.col("ret").alias("x")).join(panel.filter(F.col("algo_id") == b).select("date", F.col("ret").alias("y")), "date")
    w = Window.orderBy("date")
    x = x.withColumn("rn", F.row_number().over(w)).withColumn("corr", corr("x", "y", w.rowsBetween(-(n - 1), 0)))
    return x.filter(F.col("rn") >= n).select("date", "corr")


def mean_correlation(panel: DataFrame, top: int, days: int, least: int = 5, including: bool = True) -> DataFrame:
    """(date, mean_corr, pairs) over all pairs of the `top` busiest, on windows of `days` dates, each window one matrix.

    Every date's values are copied to the windows they belong to (`days` copies of `top` values at most), and a block
    of dates is worked off at a time.
    """
    few = busiest(panel, top)
    x = panel.join(F.broadcast(few), "algo_id").filter("ret IS NOT NULL").select("algo_id", "date", "ret")
    order = x.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date on record
    x = x.join(order, "date")
    size = max(4 * days, 256)
    first = F.floor(F.col("i") / size)
    last = F.floor((F.col("i") + days - (1 if including else 0)) / size)
    blocks = x.withColumn("block", F.explode(F.sequence(first, last)))

    def windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dates = pdf[["i", "date"]].drop_duplicates().set_index("i")["date"]
        m = pdf.pivot_table(index="i", columns="algo_id", values="ret", aggfunc="first")
        m = m.reindex(range(int(m.index.min()), int(m.index.max()) + 1))
        v, start = m.to_numpy(float), int(m.index[0])
        out = []
        for t in range(key[0] * size, (key[0] + 1) * size):
            if t not in dates.index:
                continue
            hi = t - start + (1 if including else 0)
            w = v[max(0, hi - days) : max(0, hi)]
            if hi < days or len(w) < days:
                continue
            has = ~np.isnan(w)
            h, z = has.astype(float), np.where(has, w, 0.0)
            n, s, q, c = h.T @ h, z.T @ h, (z * z).T @ h, z.T @ z
            i, j = np.triu_indices(w.shape[1], 1)
            k = n[i, j] >= least
            i, j = i[k], j[k]
            nn = n[i, j]
            va, vb = q[i, j] - s[i, j] ** 2 / nn, q[j, i] - s[j, i] ** 2 / nn
            ok = (va > 1e-10 * 1e-4) & (vb > 1e-10 * 1e-4)
            r = (c[i, j] - s[i, j] * s[j, i] / nn)[ok] / np.sqrt(va[ok] * vb[ok])
            if len(r):
                out.append((dates[t], float(r.mean()), len(r)))
        return pd.DataFrame(out, columns=["date", "mean_corr", "pairs"])

    return blocks.groupBy("block").applyInPandas(windows, "date date, mean_corr double, pairs long")


def diversification(moments_: DataFrame) -> DataFrame:
    """(ratio, n): equal weights' mean deviation over the portfolio's, from pair covariances; 1 for fewer than two."""
    n = F.col("n")
    var_a, var_b = (F.col("saa") - F.col("sa") ** 2 / n) / (n - 1), (F.col("sbb") - F.col("sb") ** 2 / n) / (n - 1)
    cov = (F.col("sab") - F.col("sa") * F.col("sb") / n) / (n - 1)
    x = moments_.filter("n > 1").select("a", "b", var_a.alias("va"), var_b.alias("vb"), cov.alias("cov"))
    own = x.select(F.col("a").alias("k"), F.col("va").alias("v")).unionByName(x.select(F.col("b").alias("k"), F.col("vb").alias("v"))).groupBy("k").agg(F.avg("v").alias("v"))
    s = own.agg(F.sum(F.sqrt("v")).alias("sd"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    c = x.agg(F.sum("cov").alias("c"))
    total = F.col("v") + 2 * F.col("c")
    return with_single(s, c).select(F.when((F.col("n") >= 2) & (total > 0), F.col("sd") / F.sqrt(F.when(total > 0, total))).otherwise(1.0).alias("ratio"), "n")


def cointegration(prices: DataFrame, pairs: DataFrame, least: int = 60) -> DataFrame:
    """(a, b, hedge, t_stat, half_life, z, n) for the given pairs of price series (algo_id, date, close).

    Hedge ratio: sample covariance over population variance. t_stat: Dickey-Fuller without lags on the residual.
    half_life: -ln 2 / phi, at most 9999. z: the last residual's. Pairs with fewer than `least` common days are left out.
    """
    left = prices.select(F.col("algo_id").alias("a"), "date", F.col("close").alias("y"))
    right = prices.select(F.col("algo_id").alias("b"), "date", F.col("close").alias("x"))
    j = pairs.select("a", "b").join(left, "a").join(right, ["b", "date"])
    fit = j.groupBy("a", "b").agg(F.covar_samp("y", "x").alias("c"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.col("v") > 0))
    r = j.join(fit, ["a", "b"]).withColumn("hedge", F.col("c") / F.col("v")).withColumn("e", F.col("y") - F.col("hedge") * F.col("x"))
    w = Window.partitionBy("a", "b").orderBy("date")
    r = r.withColumn("lag", F.lag("e").over(w)).withColumn("de", F.col("e") - F.col("lag"))
    g = r.groupBy("a", "b").agg(
        F.first("hedge").alias("hedge"), F.max("n").alias("n"), F.regr_slope("de", "lag").alias("phi"), F.regr_syy("de", "lag").alias("syy"), F.regr_sxx("de", "lag").alias("sxx"), F.regr_sxy("de", "lag").alias("sxy"),
        F.regr_count("de", "lag").alias("m"), F.avg("e").alias("me"), F.stddev_samp("e").alias("se"), F.max_by("e", "date").alias("le"),
    )
    rss = F.col("syy") - F.col("phi") * F.col("sxy")
    error = F.sqrt(F.greatest(rss, F.lit(0.0)) / (F.col("m") - 2) / F.col("sxx"))
    half = F.when(F.col("phi") < 0, F.least(-F.ln(F.lit(2.0)) / F.when(F.col("phi") < 0, F.col("phi")), F.lit(9999.0))).otherwise(9999.0)
    return g.select("a", "b", "hedge", (F.col("phi") / F.when(error > 0, error)).alias("t_stat"), half.alias("half_life"), ((F.col("le") - F.col("me")) / F.when(F.col("se") > 0, F.col("se"))).alias("z"), "n")


def cross_moments(left: DataFrame, right: DataFrame, block_days: int = 256) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) of every left with every right entity (each k, date, v), over their common days, by blocks of dates.

    What a block holds is its dates times the entities of both sides; the pairs are the result's own rows.
    """
    block = F.floor(F.unix_date("date") / block_days)
    a, b = (x.select("k", "date", "v", block.alias("block")).filter("v IS NOT NULL") for x in (left, right))
    columns = ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"]

    def gram(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=columns)
        p, q = (z.pivot_table(index="date", columns="k", values="v", aggfunc="first") for z in (x, y))
        days = p.index.intersection(q.index)
        if not len(days):
            return pd.DataFrame(columns=columns)
        p, q = p.loc[days], q.loc[days]
        u, v = p.to_numpy(float), q.to_numpy(float)
        hu, hv = (~np.isnan(u)).astype(float), (~np.isnan(v)).astype(float)
        u, v = np.nan_to_num(u), np.nan_to_num(v)
        n = hu.T @ hv
        i, j = np.nonzero(n)
        return pd.DataFrame({"a": p.columns.to_numpy()[i], "b": q.columns.to_numpy()[j], "n": n[i, j], "sa": (u.T @ hv)[i, j], "sb": (hu.T @ v)[i, j], "saa": ((u * u).T @ hv)[i, j], "sbb": (hu.T @ (v * v))[i, j], "sab": (u.T @ v)[i, j]})

    parts = a.groupBy("block").cogroup(b.groupBy("block")).applyInPandas(gram, "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double")
    return parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in columns[2:]))


def screen(left: DataFrame, right: DataFrame, k: int, least: int = 20) -> DataFrame:
    """(a, b, corr, n, rank): per left entity the k strongest correlated right ones with at least `least` common days."""
    m = cross_moments(left, right).filter(F.col("n") >= least).withColumn("corr", F.round(corr_column(), 9)).filter("corr IS NOT NULL")
    w = Window.partitionBy("a").orderBy(F.abs("corr").desc(), "b")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("a", "b", "corr", F.col("n").cast("long").alias("n"), "rank")


def signals(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, pearson, spearman, beta, agreement, n) for the given pairs on their common days; beta: sample covariance over population variance."""
    j = pairs.select("a", "b").join(left.select(F.col("k").alias("a"), "date", F.col("v").alias("x")), "a").join(right.select(F.col("k").alias("b"), "date", F.col("v").alias("y")), ["b", "date"])
    part = Window.partitionBy("a", "b")

    def rank(c: str) -> Column:
        return F.rank().over(part.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("a", "b", c)) - 1) / 2.0

    j = j.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    v = F.var_pop("y")
    same = F.when((F.col("x") != 0) & (F.col("y") != 0), (F.signum("x") == F.signum("y")).cast("int"))
    return j.groupBy("a", "b").agg(corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"), (F.covar_samp("x", "y") / F.when(v > 0, v)).alias("beta"), F.avg(same).alias("agreement"), F.count(F.lit(1)).alias("n"))


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    from math import lgamma

    flip = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    t = np.clip(t, 1e-300, 1 - 1e-16)
    front = np.exp(np.array([lgamma(u + w) - lgamma(u) - lgamma(w) for u, w in zip(p, q)]) + p * np.log(t) + q * np.log1p(-t)) / p
    c, d = np.ones_like(t), 1 / np.where(np.abs(1 - (p + q) * t / (p + 1)) < 1e-300, 1e-300, 1 - (p + q) * t / (p + 1))
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + num * d) < 1e-300, 1e-300, 1 + num * d)
            c = np.where(np.abs(1 + num / c) < 1e-300, 1e-300, 1 + num / c)
            h *= d * c
    out = front * h
    return np.where(flip, 1 - out, out)


def p_value(corr: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation over n observations, by Student's t; missing below three observations."""
    r, k = corr.to_numpy(float), n.to_numpy(float) - 2
    ok = (k > 0) & np.isfinite(r)
    out = np.full(len(r), np.nan)
    rr = np.clip(np.abs(r[ok]), 0, 1 - 1e-15)
    t2 = rr * rr * k[ok] / (1 - rr * rr)
    out[ok] = _incomplete_beta(k[ok] / 2, 0.5, k[ok] / (k[ok] + t2))
    return pd.Series(out)


def with_p_value(df: DataFrame, corr: str = "corr", n: str = "n") -> DataFrame:
    f = F.pandas_udf(p_value, "double")
    return df.withColumn("p_value", f(F.col(corr), F.col(n).cast("double")))


def first_component_share(panel: DataFrame, top: int, days: int, least: int = 3) -> DataFrame:
    """(date, share): the first principal component's share of the variance of the `days` dates before, standardised, over complete columns."""
    few = busiest(panel, top)
    x = panel.join(F.broadcast(few), "algo_id").filter("ret IS NOT NULL").select("algo_id", "date", "ret")
    order = x.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date on record
    size = max(4 * days, 256)
    blocks = x.join(order, "date").withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / size), F.floor((F.col("i") + days) / size))))

    def windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dates = pdf[["i", "date"]].drop_duplicates().set_index("i")["date"]
        m = pdf.pivot_table(index="i", columns="algo_id", values="ret", aggfunc="first")
        m = m.reindex(range(int(m.index.min()), int(m.index.max()) + 1))
        v, start, out = m.to_numpy(float), int(m.index[0]), []
        for t in range(key[0] * size, (key[0] + 1) * size):
            hi = t - start
            if t not in dates.index or t < days or hi < days:
                continue
            w = v[hi - days : hi]
            w = w[:, ~np.isnan(w).any(0)]
            w = w[:, w.std(0) > 1e-12] if w.size else w
            if w.shape[1] >= least and len(w) >= 10:
                e = np.linalg.eigvalsh(np.corrcoef(w, rowvar=False))
                out.append((dates[t], float(e[-1] / e.sum())))
        return pd.DataFrame(out, columns=["date", "share"])

    return blocks.groupBy("block").applyInPandas(windows, "date date, share double")
