"""Variants of correlation and covariance over a bounded set of entities, their stability over time, and cointegration by residuals.

The entities are the `top` with the most rows (see pairs); a matrix over them has at most top x top numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_single
from .pairs import busiest, moments


def correlations_own_means(panel: DataFrame, top: int = 100, key: str = "algo_id") -> DataFrame:
    """(a, b, corr, n), a < b: Pearson with each column's mean over all its own rows and deviations on the common rows only.

    0 where there are at most two common rows or a side hardly varies on them.
    """
    own = panel.filter("ret IS NOT NULL").groupBy(key).agg(F.avg("ret").alias("m"))
    x = moments(panel, top, key).join(own.select(F.col(key).alias("a"), F.col("m").alias("ma")), "a").join(own.select(F.col(key).alias("b"), F.col("m").alias("mb")), "b")
    n, ma, mb = F.col("n"), F.col("ma"), F.col("mb")
    cov = F.col("sab") - ma * F.col("sb") - mb * F.col("sa") + n * ma * mb
    va, vb = F.col("saa") - 2 * ma * F.col("sa") + n * ma * ma, F.col("sbb") - 2 * mb * F.col("sb") + n * mb * mb
    ok = (n > 2) & (va > 1e-10) & (vb > 1e-10)
    return x.select("a", "b", F.when(ok, cov / F.sqrt(F.when(ok, va * vb))).otherwise(0.0).alias("corr"), n.cast("long").alias("n"))


def shrunk_covariance(panel: DataFrame, shrinkage: float = 0.1, top: int = 100, key: str = "algo_id", least_eigenvalue: float = 1e-8) -> DataFrame:
    """(a, b, cov), a <= b: sample covariance over all dates on record, missing returns as 0, drawn towards the mean variance on the diagonal.

    Where the smallest eigenvalue is below `least_eigenvalue`, the diagonal is raised by what is missing: one task with
    the numbers of the matrix, top x top at most. A trace of 0 counts as a mean variance of 1e-4.
    """
    few = busiest(panel, top, key)
    x = panel.join(F.broadcast(few), key).filter("ret IS NOT NULL")
    days = x.agg(F.count_distinct("date").alias("t"))
    own = with_single(x.groupBy(key).agg(F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q")), days)
    square = own.select(F.col(key).alias("a"), F.col(key).alias("b"), F.col("q").alias("c"), "s", F.col("t").cast("double"))
    cross = moments(panel, top, key).select("a", "b", F.col("sab").alias("c"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("t"))

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["s"].notna()].sort_values("a")
        names, s, t = mine["a"].to_numpy(), mine["s"].to_numpy(float), float(mine["t"].iloc[0])
        i, j = np.searchsorted(names, pdf["a"]), np.searchsorted(names, pdf["b"])
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = pdf["c"].to_numpy(float)
        m = (m - np.outer(s, s) / t) / (t - 1) if t > 1 else np.zeros_like(m)
        mean = np.trace(m) / len(names)
        m = (1 - shrinkage) * m + shrinkage * (mean if mean > 0 else 1e-4) * np.eye(len(names))
        m += max(0.0, least_eigenvalue - np.linalg.eigvalsh(m)[0]) * np.eye(len(names))
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({"a": names[i], "b": names[j], "cov": m[i, j]})

    return square.unionByName(cross).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(shrink, "a string, b string, cov double")


def _blocks_of_windows(panel: DataFrame, top: int, days: int) -> tuple[DataFrame, int]:
    """The panel of the busiest, each row in the block of its date and in the next one if a window from there reaches it."""
    x = panel.join(F.broadcast(busiest(panel, top)), "algo_id").filter("ret IS NOT NULL").select("algo_id", "date", "ret")
    order = x.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date on record
    size = max(4 * days, 256)
    return x.join(order, "date").withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / size), F.floor((F.col("i") + days - 1) / size)))), size


def _windows(key: tuple, pdf: pd.DataFrame, size: int, days: int):
    """(date, matrix of the window that ends there) for the dates of a block that have a whole window."""
    dates = pdf[["i", "date"]].drop_duplicates().set_index("i")["date"]
    m = pdf.pivot_table(index="i", columns="algo_id", values="ret", aggfunc="first")
    m = m.reindex(range(int(m.index.min()), int(m.index.max()) + 1))
    v, start = m.to_numpy(float), int(m.index[0])
    for t in range(max(key[0] * size, days - 1), (key[0] + 1) * size):
        if t in dates.index and t - start + 1 >= days:
            yield dates[t], m.columns.to_numpy(), v[t - start + 1 - days : t - start + 1]


def correlation_stability(panel: DataFrame, top: int = 50, days: int = 63, least: int = 5, at_least: int = 10) -> DataFrame:
    """(a, b, n, mean_corr, std_corr, min_corr, max_corr, range_corr) of the correlations in all windows of `days` dates, of every pair.

    A window counts for a pair with `least` common rows that vary; a pair needs `at_least` windows. Each block of dates
    gives sums by pair, which are added up.
    """
    blocks, size = _blocks_of_windows(panel, top, days)
    columns = ["a", "b", "n", "s", "q", "lo", "hi"]

    def stable(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        acc = None
        for _, names, w in _windows(key, pdf, size, days):
            h, z = (~np.isnan(w)).astype(float), np.nan_to_num(w)
            n, s, q = h.T @ h, z.T @ h, (z * z).T @ h
            with np.errstate(divide="ignore", invalid="ignore"):
                va, vb = q - s * s / n, q.T - s.T * s.T / n
                r = (z.T @ z - s * s.T / n) / np.sqrt(va * vb)
            ok = (n >= least) & (va > 1e-14) & (vb > 1e-14)
            r = np.where(ok, r, 0.0)
            if acc is None:
                acc = [np.zeros_like(r), np.zeros_like(r), np.zeros_like(r), np.full_like(r, np.inf), np.full_like(r, -np.inf)]
            acc[0] += ok
            acc[1] += r
            acc[2] += r * r
            acc[3] = np.where(ok, np.minimum(acc[3], r), acc[3])
            acc[4] = np.where(ok, np.maximum(acc[4], r), acc[4])
        if acc is None:
            return pd.DataFrame(columns=columns)
        i, j = np.triu_indices(len(names), 1)
        keep = acc[0][i, j] > 0
        i, j = i[keep], j[keep]
        return pd.DataFrame(dict(zip(columns, [names[i], names[j], *(c[i, j] for c in acc)])))

    parts = blocks.groupBy("block").applyInPandas(stable, "a string, b string, n double, s double, q double, lo double, hi double")
    g = parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("n") >= at_least)
    dev = F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    return g.select("a", "b", F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("mean_corr"), dev.alias("std_corr"), F.col("lo").alias("min_corr"), F.col("hi").alias("max_corr"), (F.col("hi") - F.col("lo")).alias("range_corr"))


def rolling_diversification(panel: DataFrame, top: int = 50, days: int = 63) -> DataFrame:
    """(date, ratio): equal weights' mean deviation over the portfolio's, in the `days` dates up to each; 1 where that hardly varies.

    Deviations over each column's own rows of the window, covariances over the common rows about those means.
    """
    blocks, size = _blocks_of_windows(panel, top, days)
    names = blocks.agg(F.sort_array(F.collect_set("algo_id")).alias("names"))  # at most `top`

    def ratios(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, n_all = [], len(pdf["names"].iloc[0])
        for date, _, w in _windows(key, pdf, size, days):
            h = (~np.isnan(w)).astype(float)
            n = h.sum(0)
            mean = np.nan_to_num(w).sum(0) / np.maximum(n, 1)
            z = np.where(h > 0, np.nan_to_num(w) - mean, 0.0)
            pairs, cov = h.T @ h, z.T @ z
            cov = np.where(pairs > 1, cov / np.maximum(pairs - 1, 1), cov)
            vol = np.where(n > 1, np.sqrt((z * z).sum(0) / np.maximum(n - 1, 1)), 0.0)
            total = np.sqrt(max(cov.sum(), 0.0)) / n_all
            out.append((date, float(vol.sum() / n_all / total) if n_all >= 2 and total >= 1e-10 else 1.0))
        return pd.DataFrame(out, columns=["date", "ratio"])

    return with_single(blocks, names).groupBy("block").applyInPandas(ratios, "date date, ratio double")


def cointegration_residuals(prices: DataFrame, pairs: DataFrame, least: int = 60) -> DataFrame:
    """(a, b, adf_stat, is_cointegrated_5pct, is_cointegrated_10pct, hedge_ratio, half_life_days, spread_mean, spread_std, current_z_score, n_days).

    The residual of a on a constant and b; hedge ratio and phi are sample covariances over population variances, the
    error of phi is the population deviation of what it leaves over that of the lagged residual and the root of the
    number of steps. Half-life -ln 2 / phi, at most 9999. Pairs with fewer than `least` common days, or whose residual
    does not vary, give nothing.
    """
    # Critical values of the test with two variables, 5 % and 10 %.
    five, ten = -3.34, -3.04
    left = prices.select(F.col("algo_id").alias("a"), "date", F.col("close").alias("y"))
    right = prices.select(F.col("algo_id").alias("b"), "date", F.col("close").alias("x"))
    j = pairs.select("a", "b").join(left, "a").join(right, ["b", "date"]).filter("x IS NOT NULL AND y IS NOT NULL")
    v = F.var_pop("x")
    fit = j.groupBy("a", "b").agg(F.when(v > 0, F.covar_samp("y", "x") / F.when(v > 0, v)).otherwise(0.0).alias("h"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    e = F.col("y") - (F.col("my") - F.col("h") * F.col("mx") + F.col("h") * F.col("x"))
    w = Window.partitionBy("a", "b").orderBy("date")
    r = j.join(fit, ["a", "b"]).withColumn("e", e).withColumn("lag", F.lag("e").over(w)).withColumn("de", F.col("e") - F.col("lag"))
    steps = r.groupBy("a", "b").agg(F.covar_samp("de", "lag").alias("c"), F.var_pop("lag").alias("v")).withColumn("phi", F.when(F.col("v") > 0, F.col("c") / F.when(F.col("v") > 0, F.col("v"))).otherwise(0.0))
    r = r.join(steps, ["a", "b"]).filter(F.sqrt("v") >= 1e-10)
    left_over = F.when(F.col("lag").isNotNull(), F.col("de") - F.col("phi") * F.col("lag"))
    g = r.groupBy("a", "b").agg(
        F.first("h").alias("h"), F.first("phi").alias("phi"), F.first("v").alias("v"), F.stddev_pop(left_over).alias("s"), F.count("lag").alias("m"), F.avg("e").alias("me"), F.stddev_pop("e").alias("se"), F.max_by("e", "date").alias("le"), F.max("n").alias("n")
    )
    error = F.col("s") / (F.sqrt("v") * F.sqrt(F.col("m")))
    t = F.when(error > 0, F.col("phi") / F.when(error > 0, error)).otherwise(0.0)
    half = F.when(F.col("phi") < 0, F.least(-F.ln(F.lit(2.0)) / F.when(F.col("phi") < 0, F.col("phi")), F.lit(9999.0))).otherwise(9999.0)
    z = F.when(F.col("se") > 0, (F.col("le") - F.col("me")) / F.when(F.col("se") > 0, F.col("se"))).otherwise(0.0)
    return g.select("a", "b", t.alias("adf_stat"), (t < five).alias("is_cointegrated_5pct"), (t < ten).alias("is_cointegrated_10pct"), F.col("h").alias("hedge_ratio"), half.alias("half_life_days"), F.col("me").alias("spread_mean"), F.col("se").alias("spread_std"), z.alias("current_z_score"), F.col("n").alias("n_days"))


def style_weights(y: np.ndarray, x: np.ndarray, steps: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """Weights in [0, 1] with a sum of at most 1 that explain y by the columns of x with the least squares.

    Accelerated projected gradients on the set {w >= 0, sum w <= 1}, which implies w <= 1.
    """

    def project(w: np.ndarray) -> np.ndarray:
        p = np.maximum(w, 0.0)
        if p.sum() <= 1:
            return p
        u = np.sort(w)[::-1]
        k = np.arange(1, len(w) + 1)
        shift = (np.cumsum(u) - 1) / k
        return np.maximum(w - shift[np.flatnonzero(u > shift)[-1]], 0.0)

    q, c = x.T @ x, x.T @ y
    bound = float(np.linalg.eigvalsh(q)[-1])
    w = z = np.full(x.shape[1], 1 / (x.shape[1] + 1))
    t = 1.0
    if bound <= 0:
        return w
    for _ in range(steps):
        new = project(z - (q @ z - c) / bound)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / nt * (new - w)
        done = np.abs(new - w).max() < tolerance
        w, t = new, nt
        if done:
            break
    return w


def style_regression(left: DataFrame, right: DataFrame, candidates: DataFrame, least: int = 30) -> DataFrame:
    """(a, b, exposure_pct, unexplained_pct, r_squared, alpha_annual_pct, tracking_error_pct, n_overlap): returns-based style analysis.

    candidates: (a, b) the few benchmarks of each entity; left and right: (k, date, v). Only dates on which the entity
    and all its candidates have a value count; entities with fewer than `least` give nothing. A task holds one
    entity's dates times its candidates.
    """
    j = candidates.select("a", "b").distinct().join(left.select(F.col("k").alias("a"), "date", F.col("v").alias("y")), "a").join(right.select(F.col("k").alias("b"), "date", F.col("v").alias("x")), ["b", "date"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="date", columns="b", values="x", aggfunc="first").dropna()
        y = pdf.drop_duplicates("date").set_index("date")["y"].loc[m.index].to_numpy(float)
        if len(m) < least:
            return pd.DataFrame(columns=["a", "b", "exposure_pct", "unexplained_pct", "r_squared", "alpha_annual_pct", "tracking_error_pct", "n_overlap"])
        x = m.to_numpy(float)
        w = style_weights(y, x)
        rest = y - x @ w
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - (rest**2).sum() / total if total > 0 else 0.0
        return pd.DataFrame({"a": pdf["a"].iloc[0], "b": m.columns, "exposure_pct": w * 100, "unexplained_pct": (1 - w.sum()) * 100, "r_squared": r2, "alpha_annual_pct": rest.mean() * 25_200, "tracking_error_pct": rest.std() * np.sqrt(252) * 100, "n_overlap": len(m)})

    return j.groupBy("a").applyInPandas(fit, "a string, b string, exposure_pct double, unexplained_pct double, r_squared double, alpha_annual_pct double, tracking_error_pct double, n_overlap long")
