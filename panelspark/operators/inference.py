"""What an algorithm trades: six signals against screened candidates, the composite, the confidence ladder and the residual cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import corr
from ..sources.tables import with_single
from .pairs import with_p_value


def _aligned(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, date, x, y): the common days of the given pairs; left and right are (k, date, v)."""
    return pairs.select("a", "b").join(left.select(F.col("k").alias("a"), "date", F.col("v").alias("x")), "a").join(right.select(F.col("k").alias("b"), "date", F.col("v").alias("y")), ["b", "date"]).filter("x IS NOT NULL AND y IS NOT NULL")


def _average_rank(c: str) -> Column:
    return F.rank().over(Window.partitionBy("a", "b").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("a", "b", c)) - 1) / 2.0


def _number(c: Column) -> Column:
    """0 for null and NaN."""
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def deep_signals(pairs: DataFrame, left: DataFrame, right: DataFrame, least: int = 20) -> DataFrame:
    """(a, b, n_overlap, pearson_r, spearman_r, beta, dd_corr, vol_regime_corr, directional_agreement, composite_score).

    On the common days of each pair, `least` at least: Pearson and Spearman; sample covariance over the candidate's
    population variance; correlation of drawdowns and of rolling deviations (window: a third of the days, 20 at most);
    share of days with equal signs. What is not defined counts 0.
    """
    w = Window.partitionBy("a", "b").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    j = _aligned(pairs, left, right).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a", "b"))).filter(F.col("n") >= least)
    j = j.withColumn("rn", F.row_number().over(w)).withColumn("rx", _average_rank("x")).withColumn("ry", _average_rank("y"))
    for c in "xy":
        j = j.withColumn(f"p{c}", F.product(1 + F.col(c)).over(upto))
        top = F.max(f"p{c}").over(upto)
        j = j.withColumn(f"d{c}", (F.col(f"p{c}") - top) / F.when(top != 0, top))
        j = j.withColumn(f"s{c}", F.sum(c).over(upto)).withColumn(f"q{c}", F.sum(F.col(c) * F.col(c)).over(upto))
    # The window's length differs by pair, so its sums are differences of running sums, the earlier one joined by row number.
    width = F.least(F.lit(20), F.floor(F.col("n") / 3)).cast("int")
    j = j.withColumn("width", width)
    before = j.select("a", "b", (F.col("rn") + F.col("width")).alias("rn"), *(F.col(c).alias(f"{c}0") for c in ("sx", "sy", "qx", "qy")))
    j = j.join(before, ["a", "b", "rn"], "left")

    def deviation(c: str) -> Column:
        s, q = (F.col(f"{k}{c}") - F.coalesce(F.col(f"{k}{c}0"), F.lit(0.0)) for k in "sq")
        k = F.col("width")
        return F.when(F.col("rn") >= k, F.sqrt(F.greatest((q - s * s / k) / (k - 1), F.lit(0.0))))

    j = j.withColumn("vx", deviation("x")).withColumn("vy", deviation("y"))
    v = F.var_pop("y")
    g = j.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_overlap"), _number(corr("x", "y")).alias("pearson_r"), _number(corr("rx", "ry")).alias("spearman_r"), F.when(v > 1e-10, F.covar_samp("x", "y") / F.when(v > 1e-10, v)).otherwise(0.0).alias("beta"),
        _number(corr("dx", "dy")).alias("dd_corr"), _number(corr("vx", "vy")).alias("vol_regime_corr"), F.avg((F.signum("x") == F.signum("y")).cast("int")).alias("directional_agreement"),
    )
    # The weights of the signals.
    composite = 0.25 * F.abs("pearson_r") + 0.15 * F.abs("spearman_r") + 0.20 * F.least(F.abs("beta"), F.lit(2.0)) / 2 + 0.15 * F.greatest("dd_corr", F.lit(0.0)) + 0.15 * F.greatest("vol_regime_corr", F.lit(0.0)) + 0.10 * F.col("directional_agreement")
    return g.withColumn("composite_score", composite)


def residual_exposures(signals: DataFrame, best: DataFrame, left: DataFrame, right: DataFrame, least: int = 20) -> DataFrame:
    """(a, b, corr, beta, n, p_value) of the other candidates that explain what the best one leaves: |corr| > 0.1 and p < 0.10.

    best: (a, best, best_beta). The residual is the entity's return minus best_beta times the best candidate's, on
    their common days; cascades start from a beta beyond 0.01 and `least` common days.
    """
    b = best.filter(F.abs("best_beta") > 0.01)
    own = b.join(left.select(F.col("k").alias("a"), "date", F.col("v").alias("x")), "a").join(right.select(F.col("k").alias("best"), "date", F.col("v").alias("y")), ["best", "date"]).filter("x IS NOT NULL AND y IS NOT NULL")
    rest = own.select("a", "best", "date", (F.col("x") - F.col("best_beta") * F.col("y")).alias("r")).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("a"))).filter(F.col("k") >= least)
    others = signals.select("a", "b").join(rest, "a").filter("b <> best").join(right.select(F.col("k").alias("b"), "date", F.col("v").alias("z")), ["b", "date"]).filter("z IS NOT NULL")
    v = F.var_pop("z")
    g = others.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), corr("r", "z").alias("corr"), F.when(v > 1e-10, F.covar_samp("r", "z") / F.when(v > 1e-10, v)).otherwise(0.0).alias("beta")).filter(F.col("n") >= least)
    return with_p_value(g).filter("abs(corr) > 0.1 AND p_value < 0.10 AND NOT isnan(corr)")


def infer(signals: DataFrame, classes: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, best, asset_class, label, direction, confidence, best_composite, n_exposures, exposures): one row per entity with a signal.

    signals: deep_signals(); classes: (b, asset_class), candidates without one have the class `?`. The best candidate
    has the greatest composite, ties by name. Confidence: above 0.5 and significant (p < 0.05) 100 times the composite
    and 15, at most 95; above 0.3 and significant 100 times; above 0.2 80 times, at least 10; else 50 times, at least 5.
    Two exposures of different classes make the class `mixed` and cost ten points of confidence, down to 10.
    """
    s = with_p_value(signals, "pearson_r", "n_overlap").join(classes, "b", "left").withColumn("asset_class", F.coalesce("asset_class", F.lit("?")))
    rounded = s.select("a", "b", "asset_class", *(F.round(c, 4).alias(c) for c in ("pearson_r", "p_value", "beta", "composite_score")))
    first = Window.partitionBy("a").orderBy(F.col("composite_score").desc(), "b")
    best = rounded.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").withColumnRenamed("b", "best")
    rest = residual_exposures(signals, best.select("a", "best", F.col("beta").alias("best_beta")), left, right)
    side = lambda c: F.when(c < -0.1, "short").when(c > 0.1, "long").otherwise("neutral")
    exposure = F.struct(F.lit(1).alias("order"), F.col("b").alias("name"), "asset_class", side(F.col("corr")).alias("direction"), F.round("corr", 4).alias("corr"), F.round("beta", 4).alias("beta"))
    found = rest.join(classes, "b", "left").withColumn("asset_class", F.coalesce("asset_class", F.lit("?"))).groupBy("a").agg(F.sort_array(F.collect_list(exposure)).alias("others"))
    top = F.struct(F.lit(0).alias("order"), F.col("best").alias("name"), "asset_class", side(F.col("pearson_r")).alias("direction"), F.col("pearson_r").alias("corr"), "beta")
    x = best.join(found, "a", "left").withColumn("exposures", F.concat(F.array(top), F.coalesce("others", F.array().cast("array<struct<order:int,name:string,asset_class:string,direction:string,corr:double,beta:double>>"))))
    score, significant = F.col("composite_score"), F.col("p_value") < 0.05
    ladder = (
        F.when((score > 0.5) & significant, F.least(F.lit(95), F.floor(score * 100 + 15)))
        .when((score > 0.3) & significant, F.floor(score * 100))
        .when(score > 0.2, F.greatest(F.lit(10), F.floor(score * 80)))
        .otherwise(F.greatest(F.lit(5), F.floor(score * 50)))
    )
    several = F.size("exposures") >= 2
    mixed = several & (F.size(F.array_distinct(F.col("exposures.asset_class"))) >= 2)
    opaque = (score < 0.15) & (F.size("exposures") <= 1)
    names = F.array_join(F.slice(F.col("exposures.name"), 1, 4), ", ")
    two = lambda i: F.concat(F.col("exposures")[i]["name"], F.lit(" ("), F.col("exposures")[i]["asset_class"], F.lit(")"))
    label = (
        F.when(opaque, "Opaque / Unidentified strategy")
        .when(mixed, F.concat(F.lit("Mixed: "), two(0), F.lit(" + "), two(1)))
        .when(several & F.col("asset_class").isin("equity", "etf"), F.concat(F.lit("Multi-equity: "), names))
        .otherwise(two(0))
    )
    r, beta = F.col("pearson_r"), F.col("beta")
    direction = F.when((r < -0.2) & (beta < -0.1), "short/inverse").when(F.abs(r) < 0.1, "uncorrelated").otherwise("long")
    confidence = F.when(mixed, F.greatest(ladder - 10, F.lit(10))).otherwise(ladder).cast("int")
    shown = F.transform("exposures", lambda e: F.concat_ws(":", e["name"], e["direction"]))
    return x.select("a", "best", F.when(opaque, "unknown").when(mixed, "mixed").otherwise(F.col("asset_class")).alias("asset_class"), label.alias("label"), direction.alias("direction"), confidence.alias("confidence"), score.alias("best_composite"), F.size("exposures").alias("n_exposures"), F.array_join(shown, ",").alias("exposures"))


def priors(inferred: DataFrame, least_confidence: float = 60.0) -> DataFrame:
    """(a, feature, value): the confidence as a share, and 1 or 0 for every asset class and direction found, where it is confident.

    One row per entity and feature, a long form of one column per class and direction; `unknown` has none.
    """
    x = inferred.withColumn("_ok", (F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) >= least_confidence).cast("double"))
    own = x.select("a", F.lit("prior_asset_confidence").alias("feature"), F.least(F.greatest(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) / 100, F.lit(0.0)), F.lit(1.0)).alias("value"))
    parts = [own]
    for c, prefix in (("asset_class", "prior_asset_"), ("direction", "prior_direction_")):
        name = F.regexp_replace(F.lower(F.coalesce(c, F.lit("unknown"))), "[/ ]", "_")
        labels = x.select(name.alias("label")).distinct().filter("label NOT IN ('unknown', 'error', 'nan')").agg(F.collect_list("label").alias("labels"))  # the few labels
        every = x.withColumn("_label", name).select("a", "_label", "_ok")
        every = with_single(every, labels).select("a", "_label", "_ok", F.explode("labels").alias("l"))
        parts.append(every.select("a", F.concat(F.lit(prefix), "l").alias("feature"), F.when(F.col("l") == F.col("_label"), F.col("_ok")).otherwise(0.0).alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
