"""Rolling totals, averages and features per entity over trailing calendar days, days without activity included.

Every daily row is exploded onto the output dates it influences and summed there, so the work per entity spreads over
its dates and no window holds an entity. Rows of neighbouring days are first brought together (entity, block of days),
so that most of what the explosion multiplies is combined again before the second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import one_per_key

#: Days of one entity that are kept in one block before the explosion.
BLOCK_DAYS = 512


def daily(df: DataFrame, key: str, date: str, value: str, arrival: str | None = None) -> DataFrame:
    """(key, day, v): one row per entity and day, of repeated rows the last to arrive; null keys and dates left out."""
    cols = [F.col(key).alias("key"), F.col(date).cast("date").alias("day"), F.col(value).cast("double").alias("v")]
    base = df.select(*cols, *([F.col(arrival).alias("a")] if arrival else [])).filter("key IS NOT NULL AND day IS NOT NULL")
    clean = base.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return one_per_key(clean, ["key", "day"], [F.col("a")] if arrival else None).select("key", "day", "v")


def calendar(days: DataFrame) -> DataFrame:
    """(key, day, first_day): every calendar day from an entity's first to its last."""
    span = days.groupBy("key").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return span.select("key", "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))


def _dense_mean_dev(n: Column, avg: Column, dev: Column, w: int) -> tuple[Column, Column]:
    """Mean and population deviation of n values and w - n zeros."""
    mean = avg * n / w
    spread = dev * dev * n + avg * avg * n * (w - n) / w
    return mean, F.sqrt(spread / w)


def trailing(df: DataFrame, key: str, date: str, value: str, arrival: str | None = None, windows: tuple[int, ...] = (7, 30), sharpe: int = 21, compound: int = 63) -> DataFrame:
    """(key, day, total_w, mean_w for each w of windows, sharpe, compound) for every calendar day of an entity.

    Totals and means take the last w calendar days ending that day; days without a row, or with a null value, count
    as 0, also in the divisor, and so do days before the entity's first. sharpe: mean / population deviation *
    sqrt(252) over that many days, 0 if the deviation is at most 1e-10, null before that many days have passed.
    compound: product of (1 + value) - 1, null likewise. Repeated rows count once (the last to arrive); rows with a
    null key or date give nothing; an empty table gives an empty result.
    """
    days = daily(df, key, date, value, arrival)
    widest = max(*windows, sharpe, compound)
    blocked = days.filter("v IS NOT NULL AND v <> 0").withColumn("block", F.floor(F.unix_date("day") / BLOCK_DAYS))
    near = blocked.repartition("key", "block")
    spread = near.select("key", "v", "day", F.explode(F.sequence(F.lit(0), F.lit(widest - 1))).alias("ago"))
    spread = spread.select("key", F.date_add("day", F.col("ago")).alias("day"), "v", "ago")
    within = lambda w, c: F.when(F.col("ago") < w, c)
    sums = [F.sum(within(w, F.col("v"))).alias(f"s{w}") for w in windows]
    sharpe_parts = [F.count(within(sharpe, F.col("v"))).alias("n"), F.avg(within(sharpe, F.col("v"))).alias("m"), F.stddev_pop(within(sharpe, F.col("v"))).alias("d")]
    grown = F.product(within(compound, 1 + F.col("v"))).alias("g")
    influenced = spread.groupBy("key", "day").agg(*sums, *sharpe_parts, grown)

    full = calendar(days).join(influenced, ["key", "day"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    age = F.datediff("day", "first_day")
    mean, dev = _dense_mean_dev(F.coalesce("n", F.lit(0)), zero("m"), zero("d"), sharpe)
    ratio = F.when(dev <= 1e-10, 0.0).otherwise(mean / F.when(dev > 1e-10, dev) * F.sqrt(F.lit(252.0)))
    out = [F.col("key").alias(key), "day"]
    for w in windows:
        out += [zero(f"s{w}").alias(f"total_{w}"), (zero(f"s{w}") / w).alias(f"mean_{w}")]
    out += [F.when(age >= sharpe - 1, ratio).alias("sharpe"), F.when(age >= compound - 1, F.coalesce("g", F.lit(1.0)) - 1).alias("compound")]
    return full.select(*out)


def differs(stored: Column, right: Column, tolerance: float) -> Column:
    """Whether a stored value is off by more than the tolerance, or one of the two is null and the other is not."""
    stored = F.when(~F.isnan(stored), stored)
    return F.coalesce(F.abs(stored - right) > tolerance, stored.isNull() != right.isNull())
