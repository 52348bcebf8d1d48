"""Irregular readings onto a regular grid: shape-preserving monotone cubic interpolation, long gaps left marked.

Readings meet in their slot first (combined before the shuffle), then work goes by (source, shard of slots). Each
shard gets the two nearest readings on either side from wherever they lie as a halo; only the first and last two
readings of each shard pass through a window over the source. A slot's cubic then needs no more than four readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Slots of a source in one shard.
SHARD_SLOTS = 4096


def slot_number(ts: Column, step_minutes: Column, weekdays_only: Column) -> Column:
    """Number of the slot a time falls in, counting only slots that exist; null on a weekend without slots.

    Slots run from 00:00 UTC each day. 1970-01-05 was a Monday, day 4.
    """
    minute = (F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(60_000_000))) / F.lit(60_000_000)
    day = F.floor(minute / 1440)
    a_day = F.ceil(F.lit(1440) / step_minutes)
    week, weekday = F.floor((day - 4) / 7), F.pmod(day - 4, F.lit(7))
    counted = F.when(~weekdays_only, day).when(weekday < 5, week * 5 + weekday)
    return (counted * a_day + F.floor(F.pmod(minute, F.lit(1440)) / step_minutes)).cast("long")


def next_slot_number(ts: Column, step_minutes: Column) -> Column:
    """Number of the first slot after a time on a weekend without slots (Monday 00:00); null for other times."""
    day = F.floor(F.floor(F.unix_micros(ts) / F.lit(60_000_000)) / 1440)
    week, weekday = F.floor((day - 4) / 7), F.pmod(day - 4, F.lit(7))
    return F.when(weekday >= 5, (week + 1) * 5 * F.ceil(F.lit(1440) / step_minutes)).cast("long")


def slot_start(slot: Column, step_minutes: Column, weekdays_only: Column) -> Column:
    """Start of a slot as a timestamp; inverse of slot_number."""
    a_day = F.ceil(F.lit(1440) / step_minutes)
    counted = F.floor(slot / a_day)
    day = F.when(weekdays_only, F.floor(counted / 5) * 7 + F.pmod(counted, F.lit(5)) + 4).otherwise(counted)
    return F.timestamp_seconds((day * 1440 + F.pmod(slot, a_day) * step_minutes) * 60)


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """One-sided slope at an end of a segment, kept from overshooting."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(s) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def _inner_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Weighted harmonic mean of the slopes on both sides; 0 at a turning point."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    flat = (d0 == 0) | (d1 == 0)
    safe = lambda d: F.when(flat, 1.0).otherwise(d)
    return F.when(flat | (F.signum(d0) != F.signum(d1)), 0.0).otherwise((w0 + w1) / (w0 / safe(d0) + w1 / safe(d1)))


def regular_grid(readings: DataFrame, source: list[str], slot: str, value: str, order: list[str], max_gap: int = 10, shard_slots: int = SHARD_SLOTS, off_grid: str | None = None) -> DataFrame:
    """(source..., slot, value, state): one row per slot from a source's first reading to its last.

    state is `reading` (the last reading of the slot by `order`), `filled` (interpolated) or `gap` (value null: the
    hole has more than max_gap slots). A hole longer than that also ends a segment: readings beyond it shape no curve.
    Rows with a null source, slot or value are no readings. off_grid names a column with the number of the next slot for
    readings that fall in none (a weekend): they fill nothing, but the grid of a source that has other readings begins
    or ends with them; slots beyond the outermost filled one are gaps, as no curve leads there. Repeated rows and ties give the same value once. A source
    with one reading gives one row; an empty table gives an empty result.
    """
    keep = [*source, F.col(slot).cast("long").alias("k"), F.col(value).cast("double").alias("v"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))]
    base = readings.select(*keep).filter(" AND ".join(f"{c} IS NOT NULL" for c in [*source, "k", "v"]))
    last = F.max(F.struct(*(F.col(f"_o{i}") for i in range(len(order))), "v")).alias("r")
    slots = base.groupBy(*source, "k").agg(last).select(*source, "k", F.col("r.v").alias("v"))
    slots = slots.withColumn("shard", F.floor(F.col("k") / shard_slots))

    point = F.struct("k", "v")
    across = _halos(slots, source)
    w = Window.partitionBy(*source, "shard").orderBy("k")
    rows = slots.withColumn("own", F.lit(True)).unionByName(across)
    step = lambda n: (F.lead if n > 0 else F.lag)(point, abs(n)).over(w)
    near = rows.withColumn("p", step(-1)).withColumn("q", step(1)).withColumn("r", step(2)).filter("own")
    k0, k1 = F.col("k"), F.col("q.k")
    h = (k1 - k0).cast("double")
    joined_left = F.col("p.k").isNotNull() & (k0 - F.col("p.k") - 1 <= max_gap)
    joined_right = F.col("r.k").isNotNull() & (F.col("r.k") - k1 - 1 <= max_gap)
    hl, hr = (k0 - F.col("p.k")).cast("double"), (F.col("r.k") - k1).cast("double")
    d = (F.col("q.v") - F.col("v")) / h
    dl, dr = (F.col("v") - F.col("p.v")) / hl, (F.col("r.v") - F.col("q.v")) / hr
    m0 = F.when(joined_left, _inner_slope(hl, h, dl, d)).when(joined_right, _end_slope(h, hr, d, dr)).otherwise(d)
    m1 = F.when(joined_right, _inner_slope(h, hr, d, dr)).when(joined_left, _end_slope(h, hl, d, dl)).otherwise(d)
    hole = k1 - k0 - 1
    near = near.withColumn("m0", F.when((hole > 0) & (hole <= max_gap), m0)).withColumn("m1", F.when((hole > 0) & (hole <= max_gap), m1))
    until = F.coalesce(hole, F.lit(0).cast("long"))
    near = near.withColumn("until", until).select(*source, "k", "v", F.col("q.k").alias("k1"), F.col("q.v").alias("v1"), "m0", "m1", "until")
    many = F.col("until") >= shard_slots  # a hole beyond a shard is written out block by block, never as one array
    blocks = near.withColumn("b", F.explode(F.when(many, F.sequence(F.lit(0).cast("long"), F.col("until"), F.lit(shard_slots).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    out = blocks.withColumn("i", F.explode(F.sequence(F.col("b"), F.least(F.col("until"), F.col("b") + shard_slots - 1))))
    H = (F.col("k1") - F.col("k")).cast("double")
    t = F.col("i") / H
    curve = (1 + 2 * t) * (1 - t) * (1 - t) * F.col("v") + t * (1 - t) * (1 - t) * H * F.col("m0") + t * t * (3 - 2 * t) * F.col("v1") + t * t * (t - 1) * H * F.col("m1")
    state = F.when(F.col("i") == 0, "reading").when(F.col("m0").isNotNull(), "filled").otherwise("gap")
    filled = F.when(F.col("i") == 0, F.col("v")).otherwise(curve)
    grid = out.select(*source, (F.col("k") + F.col("i")).alias("slot"), filled.alias("value"), state.alias("state"))
    if off_grid is None:
        return grid
    off = readings.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*source, value, off_grid]) + f" AND {slot} IS NULL")
    off = cut_lineage(off.groupBy(*source).agg(F.min(off_grid).alias("lo"), (F.max(off_grid) - 1).alias("hi")))  # a row a source at most
    return grid.unionByName(_beyond(off, slots, source, shard_slots)) if off.limit(1).count() else grid


def _beyond(off: DataFrame, slots: DataFrame, source: list[str], shard_slots: int) -> DataFrame:
    """The gap slots between a source's outermost filled slot and a reading off the grid beyond it."""
    ends = slots.groupBy(*source).agg(F.min("k").alias("a"), F.max("k").alias("z")).join(off, source)
    side = lambda x, y: F.when(x <= y, F.struct(x.alias("x"), y.alias("y")))
    sides = F.array_compact(F.array(side(F.col("lo"), F.col("a") - 1), side(F.col("z") + 1, F.col("hi"))))
    rows = ends.select(*source, F.explode(sides).alias("s")).select(*source, "s.y", F.explode(F.sequence(F.col("s.x"), F.col("s.y"), F.lit(shard_slots).cast("long"))).alias("b"))
    rows = rows.select(*source, F.explode(F.sequence(F.col("b"), F.least(F.col("y"), F.col("b") + shard_slots - 1))).alias("slot"))
    return rows.select(*source, "slot", F.lit(None).cast("double").alias("value"), F.lit("gap").alias("state"))


def _halos(slots: DataFrame, source: list[str]) -> DataFrame:
    """Rows (source, k, v, shard, own = false): the two nearest readings before and after each shard that has readings."""
    point = F.struct("k", "v")
    w = Window.partitionBy(*source, "shard").orderBy("k")
    placed = slots.withColumn("up", F.row_number().over(w)).withColumn("n1", F.lead("k", 1).over(w)).withColumn("n2", F.lead("k", 2).over(w))
    edge = placed.filter("up <= 2 OR n1 IS NULL OR n2 IS NULL")  # at most four readings a shard
    heads = F.slice(F.array_sort(F.collect_list(point)), 1, 2).alias("head")
    tails = F.slice(F.reverse(F.array_sort(F.collect_list(point))), 1, 2).alias("tail")
    ends = edge.groupBy(*source, "shard").agg(heads, tails)
    by = Window.partitionBy(*source).orderBy("shard")
    two = lambda step, c: F.slice(F.concat(*(F.coalesce(step(c, n).over(by), F.array().cast("array<struct<k:bigint,v:double>>")) for n in (1, 2))), 1, 2)
    seen = ends.withColumn("seen", F.concat(two(F.lag, "tail"), two(F.lead, "head")))
    given = seen.select(*source, "shard", F.explode("seen").alias("x"))
    return given.select(*source, F.col("x.k").alias("k"), F.col("x.v").alias("v"), "shard", F.lit(False).alias("own"))
