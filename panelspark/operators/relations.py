"""Values in force at a date, scorecards, static folds, wide sheets as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_single
from .temporal import asof_join


def in_force(dates: DataFrame, dated: DataFrame, name: str = "since", clamp: bool = False, strict: bool = False) -> DataFrame:
    """dates (date) with the last date of `dated` (date) at or before, as `name`; clamp: the first one where there is none before.

    Both are calendars, a row per day on record.
    """
    known = dated.select("date").distinct().select(F.lit(1).alias("_k"), F.col("date").alias("_d"), F.col("date").alias(name))
    out = asof_join(dates.select("date").distinct().withColumn("_k", F.lit(1)), known, ["_k"], "date", "_d", [name], fallback="first" if clamp else "null", strict=strict)
    return out.select("date", name)


def rows_in_force(dates: DataFrame, dated: DataFrame, name: str = "since", clamp: bool = False) -> DataFrame:
    """The rows of the last date at or before each of `dates`, all of that one date: an entity without a row on it has none."""
    at = in_force(dates, dated, name, clamp).filter(F.col(name).isNotNull())
    return at.join(dated.withColumnRenamed("date", name), name)


def shared_subperiods(flows: DataFrame, share: float = 0.01) -> DataFrame:
    """(part, first, last, ret): sub-periods between successive boundaries, both days included, so that a boundary counts in two.

    Boundaries: the first and last day, and days with a flow of more than `share` of the previous equity. One series, a
    row a day. A single day gives nothing.
    """
    w = Window.orderBy("date")
    prev = F.lag("equity").over(w)
    big = F.coalesce((F.abs("flow") / F.when(prev != 0, F.abs(prev))) > share, F.lit(False))
    ends = prev.isNull() & (F.row_number().over(w) == 1) | F.lead("date").over(w).isNull()
    x = flows.withColumn("_b", big | ends)
    x = x.withColumn("_k", F.sum(F.col("_b").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = with_single(x, x.agg(F.max("_k").alias("_m")))
    parts = F.when(F.col("_b"), F.array(F.col("_k") - 1, F.col("_k"))).otherwise(F.array(F.col("_k")))
    rows = x.withColumn("part", F.explode(parts)).filter("part >= 1 AND part < _m")
    return rows.groupBy("part").agg(F.min("date").alias("first"), F.max("date").alias("last"), (F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))


def _sigmoid(x: Column, scale: Column) -> Column:
    return 1 / (1 + F.exp(-x / F.when(scale != 0, scale)))


def scorecard(series: DataFrame) -> DataFrame:
    """(date, growth, high_vol, stress, risk_on, regime, p0, p1, p2, p3) of one series: date, breadth, vol, drawdown.

    growth: sigmoid of the 21-row mean breadth, scale 0.5. high_vol: sigmoid of the volatility over its median to date,
    scale half the mean of that median. stress: size of the drawdown; risk_on: 1 - stress. regime: 0 expansion, 1
    slowdown, 2 recession, 3 recovery by the greatest score, the first of equals, 0 while something is missing.
    """
    w = Window.orderBy("date")
    mean = F.when(F.row_number().over(w) >= 21, F.avg("breadth").over(w.rowsBetween(-20, 0)))
    x = series.withColumn("_m", F.expr("percentile(vol, 0.5)").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("growth", _sigmoid(mean, F.lit(0.5)))
    x = with_single(x, x.agg(F.avg("_m").alias("_mm")))
    x = x.withColumn("high_vol", _sigmoid(F.col("vol") - F.col("_m"), F.col("_mm") * 0.5)).withColumn("stress", F.abs("drawdown")).withColumn("risk_on", 1 - F.col("stress"))
    g, h, s, r = (F.col(c) for c in ("growth", "high_vol", "stress", "risk_on"))
    scores = [F.round(c, 12) for c in (g * r * (1 - h), g * h * (1 - s), s * h * (1 - g), (1 - s) * (1 - h) * (1 - g) * 0.5 + g * 0.5)]
    best = F.greatest(*scores)
    missing = g.isNull() | h.isNull() | s.isNull()
    regime = F.when(missing | (scores[0] == best), 0).when(scores[1] == best, 1).when(scores[2] == best, 2).otherwise(3)
    probs = [g * (1 - h), g * h, s * h, (1 - s) * (1 - g)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in probs), F.lit(1e-10))
    return x.select("date", "growth", "high_vol", "stress", "risk_on", regime.alias("regime"), *((p / total).alias(f"p{i}") for i, p in enumerate(probs)))


def static_folds(weights: DataFrame, returns: DataFrame, folds: DataFrame) -> DataFrame:
    """(strategy, fold_id, date, ret): the weights set at a fold's training end, held through its test dates without drift.

    weights: strategy, fold_id, algo_id, w; folds: a row per fold with its test span. A missing return counts 0.
    """
    days = returns.select("date").distinct()
    span = folds.select("fold_id", F.explode(F.sequence("test_start", "test_end")).alias("date"))  # each date in few folds
    tested = span.join(days, "date")
    terms = tested.join(returns.select("date", "algo_id", "ret"), "date").join(weights, ["fold_id", "algo_id"]).groupBy("strategy", "fold_id", "date").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    every = tested.join(weights.select("strategy", "fold_id").distinct(), "fold_id")
    return every.join(terms, ["strategy", "fold_id", "date"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def sheet_rows(sheet: DataFrame) -> DataFrame:
    """(column, asset, value) of a wide sheet whose first text column names the asset; other text columns are left out.

    Every remaining column becomes rows, its values as numbers where they are; null values stay as rows.
    """
    text = [c for c, kind in sheet.dtypes if kind == "string"]
    if not text:
        raise ValueError("no text column names the assets")
    rest = [c for c in sheet.columns if c not in text]
    numbers = sheet.select(F.col(text[0]).alias("asset"), *(F.col(c).cast("double").alias(c) for c in rest))
    return numbers.unpivot("asset", rest, "column", "value").select("column", "asset", "value")


def tidy(wide: DataFrame, index: str, features: list[str]) -> DataFrame:
    """(index, algo_id, feature, value) of columns named `<algo>_<feature>`; of two features that fit the longer one counts, other columns are left out."""
    named = {}
    for c in wide.columns:
        fits = [f for f in features if c.endswith(f"_{f}") and len(c) > len(f) + 1]
        if c != index and fits:
            f = max(fits, key=len)
            named[c] = (c[: -len(f) - 1], f)
    cells = F.array(*(F.struct(F.lit(a).alias("algo_id"), F.lit(f).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c, (a, f) in named.items()))
    if not named:
        return wide.select(index, F.lit("").alias("algo_id"), F.lit("").alias("feature"), F.lit(None).cast("double").alias("value")).limit(0)
    return wide.select(index, F.explode(cells).alias("x")).select(index, "x.*")
