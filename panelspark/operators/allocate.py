"""Cross-sectional scores, selection, closed-form weights, one step of constraints, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscores(df: DataFrame, factors: dict[str, int], by: str = "date") -> DataFrame:
    """df with score: mean of the factors' z-scores per group (population deviation), signs by factor.

    A null counts 0; a factor that does not vary is left out of the mean; score is 0 if none varies.
    """
    w = Window.partitionBy(by)
    used, total = F.lit(0), F.lit(0.0)
    for f, sign in factors.items():
        dev = F.stddev_pop(f).over(w)
        varies = F.coalesce(dev > 1e-8, F.lit(False))
        z = (F.col(f) - F.avg(f).over(w)) / F.when(dev > 1e-8, dev) * sign
        total = total + F.when(varies, F.coalesce(z, F.lit(0.0))).otherwise(0.0)
        used = used + F.when(varies, 1).otherwise(0)
    return df.withColumn("score", F.when(used > 0, total / F.when(used > 0, used)).otherwise(0.0))


def top_n(df: DataFrame, score: str, n: int, by: str = "date", key: str = "algo_id", bottom: bool = False) -> DataFrame:
    """The n rows of each group with the greatest (or least) score; nulls excluded, ties by key."""
    order = F.col(score).asc() if bottom else F.col(score).desc()
    w = Window.partitionBy(by).orderBy(order, key)
    return df.filter(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def top_share(df: DataFrame, score: str, share: float, by: str = "date", side: str = "top") -> DataFrame:
    """Rows at or beyond the quantile that cuts off `share` of a group: top, bottom or both (side `both` adds the sign)."""
    q = df.groupBy(by).agg(F.expr(f"percentile({score}, {1 - share})").alias("_hi"), F.expr(f"percentile({score}, {share})").alias("_lo"))
    x = df.join(q, by)
    up, down = F.col(score) >= F.col("_hi"), F.col(score) <= F.col("_lo")
    keep = {"top": up, "bottom": down, "both": up | down}[side]
    return x.filter(keep).withColumn("side", F.when(up, 1).otherwise(-1)).drop("_hi", "_lo")


def share_of(df: DataFrame, raw: Column, by: str = "date") -> DataFrame:
    """df with w: raw over its sum in the group, equal weights where that is 0."""
    w = Window.partitionBy(by)
    x = df.withColumn("_raw", raw)
    s = F.sum("_raw").over(w)
    return x.withColumn("w", F.coalesce(F.col("_raw") / F.when(s > 0, s), 1.0 / F.count(F.lit(1)).over(w))).drop("_raw")


def equal(df: DataFrame, by: str = "date") -> DataFrame:
    return share_of(df, F.lit(1.0), by)


def inverse_vol(df: DataFrame, vol: str, by: str = "date", floor: float = 1e-8) -> DataFrame:
    return share_of(df, 1 / F.greatest(F.col(vol), F.lit(floor)), by)


def momentum(df: DataFrame, score: str, by: str = "date") -> DataFrame:
    return share_of(df, F.greatest(F.col(score), F.lit(0.0)), by)


def constrained(df: DataFrame, low: float, high: float, exposure: float, most_turnover: float, by: str = "date") -> DataFrame:
    """df (w, current) with w cut to [low, high] and at 0, scaled down to the exposure, then moved from `current` no further than the turnover allows."""
    g = Window.partitionBy(by)
    x = df.withColumn("_c", F.greatest(F.greatest(F.least(F.col("w"), F.lit(high)), F.lit(low)), F.lit(0.0)))
    s = F.sum("_c").over(g)
    x = x.withColumn("_e", F.when(s > exposure, F.col("_c") * exposure / F.when(s > 0, s)).otherwise(F.col("_c")))
    t = F.sum(F.abs(F.col("_e") - F.col("current"))).over(g) / 2
    x = x.withColumn("_t", t)
    moved = F.col("current") + F.lit(most_turnover) / F.when(F.col("_t") > 0, F.col("_t")) * (F.col("_e") - F.col("current"))
    return x.withColumn("w", F.when(F.col("_t") > most_turnover, moved).otherwise(F.col("_e"))).drop("_c", "_e", "_t")


def costs(df: DataFrame, spread: float, slippage: float, impact: float, fixed: float, by: str = "date") -> DataFrame:
    """(by, n_trades, turnover, cost): of the weight changes dw of more than 1e-6, as a share of the portfolio."""
    d = F.abs("dw")
    x = df.withColumn("_d", F.when(d > 1e-6, d))
    variable = F.coalesce(F.sum(F.col("_d") * (spread + slippage) + F.col("_d") * F.col("_d") * impact), F.lit(0.0))
    return x.groupBy(by).agg(F.count("_d").alias("n_trades"), (F.sum(d) / 2).alias("turnover"), (variable + F.count("_d") * fixed).alias("cost"))


def capped_minimum_variance(cov, cap: float = 1.0, steps: int = 500):
    """Long-only weights of least variance, none above cap: projected gradient on the capped simplex."""
    import numpy as np

    n = len(cov)
    cap = max(cap, 1.0 / n)
    w = np.full(n, 1.0 / n)
    rate = 1.0 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)

    def project(v):
        lo, hi = v.min() - cap, v.max()
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
        return np.clip(v - hi, 0, cap)

    for _ in range(steps):
        new = project(w - rate * (cov @ w))
        if np.abs(new - w).max() < 1e-10:
            break
        w = new
    return w


def equal_risk(cov, steps: int = 200):
    """Weights whose contributions to the variance are equal: multiplicative updates by the square root of the misfit."""
    import numpy as np

    n = len(cov)
    w = np.full(n, 1.0 / n)
    for _ in range(steps):
        m = w * (cov @ w)
        total = m.sum()
        if total <= 0 or (m <= 0).any():
            break
        new = w * np.sqrt(total / n / m)
        new /= new.sum()
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def max_sharpe(mean, cov, cap: float = 1.0, steps: int = 120):
    """Long-only weights of greatest mean over deviation by projected ascent; inverse volatility if no mean is positive."""
    import numpy as np

    if (mean <= 0).all():
        v = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-16))
        return v / v.sum()
    best, best_ratio = None, -np.inf
    for risk in np.geomspace(0.1, 1000, 9):  # along the efficient frontier
        n = len(mean)
        w = np.full(n, 1.0 / n)
        rate = 1.0 / max(risk * np.linalg.eigvalsh(cov)[-1], 1e-12)
        for _ in range(steps):
            v = w + rate * (mean - risk * (cov @ w))
            lo, hi = v.min() - 1, v.max()
            for _ in range(30):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.clip(v - mid, 0, max(cap, 1 / n)).sum() > 1 else (lo, mid)
            new = np.clip(v - hi, 0, max(cap, 1 / n))
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        ratio = (w @ mean) / np.sqrt(max(w @ cov @ w, 1e-16))
        if ratio > best_ratio:
            best, best_ratio = w, ratio
    return best


def projected(df: DataFrame, low: float, high: float, exposure: float, turnover: float, iterations: int = 10) -> DataFrame:
    """df (date, algo_id, w, current) with w brought towards the feasible set of its date by alternating projections.

    Each round clips to [low, high], scales the sum down to `exposure` and shrinks the move from `current` to
    `turnover`; a date is done once a round changes no weight by more than 1e-8 and 1e-5 of it. Null weights count 0.
    """
    by_date = Window.partitionBy("date")
    x = df.withColumn("w", F.coalesce("w", F.lit(0.0))).withColumn("current", F.coalesce("current", F.lit(0.0))).withColumn("_done", F.lit(False))
    for _ in range(iterations):
        x = x.withColumn("_c", F.greatest(F.least("w", F.lit(high)), F.lit(low)))
        x = x.withColumn("_t", F.sum("_c").over(by_date))
        x = x.withColumn("_c", F.when(F.col("_t") > exposure, F.col("_c") * exposure / F.when(F.col("_t") > exposure, F.col("_t"))).otherwise(F.col("_c")))
        x = x.withColumn("_t", F.sum(F.abs(F.col("_c") - F.col("current"))).over(by_date) / 2)
        x = x.withColumn("_c", F.when(F.col("_t") > turnover, F.col("current") + turnover / F.when(F.col("_t") > turnover, F.col("_t")) * (F.col("_c") - F.col("current"))).otherwise(F.col("_c")))
        x = x.withColumn("_n", F.when(F.col("_done"), F.col("w")).otherwise(F.col("_c")))
        still = F.max((F.abs(F.col("_n") - F.col("w")) > 1e-8 + 1e-5 * F.abs("w")).cast("int")).over(by_date) == 0
        x = x.withColumn("_done", still).withColumn("w", F.col("_n"))
    return x.drop("_c", "_t", "_n", "_done")


def decoded(budgets: DataFrame, members: DataFrame) -> DataFrame:
    """(date, algo_id, w): the weights of families spread equally over their living members; a family without any gives its share to the others in proportion.

    budgets: date, family, w; members: date, family, algo_id, those alive. Negative and null budgets count 0; a date
    whose budgets add up to 0 counts every family alike; a date without a living member in any family gives nothing.
    """
    date = Window.partitionBy("date")
    b = budgets.withColumn("_w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    total = F.sum("_w").over(date)
    b = b.withColumn("_w", F.when(total > 1e-8, F.col("_w") / F.when(total > 1e-8, total)).otherwise(1.0 / F.count(F.lit(1)).over(date)))
    alive = members.groupBy("date", "family").agg(F.count(F.lit(1)).alias("_n"))
    held = b.join(alive, ["date", "family"]).withColumn("_s", F.sum("_w").over(date))
    each = held.withColumn("_each", F.when(F.col("_s") > 1e-8, F.col("_w") / F.when(F.col("_s") > 1e-8, F.col("_s"))).otherwise(F.col("_w")) / F.col("_n"))
    return members.join(each.select("date", "family", "_each"), ["date", "family"]).select("date", "algo_id", F.col("_each").alias("w"))


def encoded(weights: DataFrame, families: DataFrame) -> DataFrame:
    """(date, family, w): the summed weights of each family's algorithms (date, algo_id, w), as shares of their sum where it is above 1e-8."""
    g = weights.join(families, "algo_id").groupBy("date", "family").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("date"))
    return g.withColumn("w", F.when(total > 1e-8, F.col("w") / F.when(total > 1e-8, total)).otherwise(F.col("w")))
