"""As-of joins, interval joins, calendar windows and rebalance schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_single


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward", fallback: str = "null", strict: bool = False, block_days: int = 32
) -> DataFrame:
    """left with `values` of the right row nearest in time: the last one at or before (backward) or the first one at or after (forward).

    strict leaves out rows at the same time. fallback="first": where nothing is at or before, the first right row of
    the key (which lies in the future); "both": those in columns of their own, `<value>_or_first`. Both sides meet in
    one sort per (key, block of block_days days, or of as many units of numeric times), in the direction in which values are carried; into each block one
    row carries the value that the blocks before it leave, so no key meets in one task. Of right rows with equal time
    the one with the greatest values counts. Null keys or times match nothing; empty sides are no case of their own.
    """
    back = direction == "backward"
    row = F.struct(*(F.col(v).alias(v) for v in values))
    whole = lambda *cs: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cs))
    timed = dict(left.dtypes)[left_ts] in ("date", "timestamp", "timestamp_ntz")
    block = lambda t: F.floor((F.unix_date(F.col(t).cast("date")) if timed else F.col(t)) / F.lit(block_days))
    r = right.filter(whole(*keys, right_ts)).groupBy(*keys, F.col(right_ts).alias("_t")).agg(F.max(row).alias("_v"))
    r = r.withColumn("_block", block("_t"))
    names = left.columns
    as_row = F.struct(*names).alias("_left")
    known = whole(*keys, left_ts)
    a = left.filter(known).select(*keys, F.col(left_ts).alias("_t"), block(left_ts).alias("_block"), as_row)

    # What each block is given: the last value in the blocks before it, in the direction of the search.
    ends = r.groupBy(*keys, "_block").agg(F.max_by("_v", "_t").alias("_last"), F.min_by("_v", "_t").alias("_first"))
    blocks = a.select(*keys, "_block").distinct().unionByName(ends, allowMissingColumns=True).groupBy(*keys, "_block").agg(F.max("_last").alias("_last"), F.max("_first").alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_block" if back else F.col("_block").desc())
    carried = F.last("_last" if back else "_first", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    given = blocks.select(*keys, "_block", carried.alias("_v"), first.alias("_f0"), F.lit(0).alias("_rank"))

    right_first = not strict  # at equal times: whether the left row sees the right one from where it stands
    both = a.withColumn("_rank", F.lit(2)).unionByName(r.withColumn("_rank", F.lit(1 if right_first else 3)), allowMissingColumns=True).unionByName(given, allowMissingColumns=True)
    time = F.col("_t") if back else F.col("_t").desc()
    w = Window.partitionBy(*keys, "_block").orderBy(F.when(F.col("_rank") == 0, 0).otherwise(1), time, "_rank").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).withColumn("_f0", F.last("_f0", ignorenulls=True).over(w)).filter("_rank = 2")
    found = F.coalesce("_v", "_f0") if fallback == "first" else F.col("_v")
    picked = [found[v].alias(v) for v in values]
    if fallback == "both":
        picked += [F.coalesce("_v", "_f0")[v].alias(f"{v}_or_first") for v in values]
    out = out.select(*(F.col("_left")[n].alias(n) for n in names), *picked)
    return out.unionByName(left.filter(~known), allowMissingColumns=True)


def clean_trade_dates(trades: DataFrame) -> DataFrame:
    """trades with day_open and day_close in order.

    No opening: no row. No closing: the greatest closing day of all (one number from one aggregate). Closing before
    opening: the opening day.
    """
    t = trades.filter("date_open IS NOT NULL AND algo_id IS NOT NULL")
    latest = trades.filter("date_open IS NOT NULL").agg(F.max(F.col("date_close").cast("date")).alias("_latest"))  # a single row
    t = with_single(t, latest).withColumn("day_open", F.col("date_open").cast("date"))
    return t.withColumn("day_close", F.greatest("day_open", F.coalesce(F.col("date_close").cast("date"), F.col("_latest")))).drop("_latest")


def active_days(trades: DataFrame, days: DataFrame, measure: str) -> DataFrame:
    """(date, algo_id, n, total) of trades with day_open <= date <= day_close, for the dates of `days` (column date).

    No interval is written out: a trade counts up on its first day and down after its last, the changes are added up
    per algorithm and day, and their running sums are read at the dates of the calendar. An algorithm's rows here are
    bounded by the calendar.
    """
    first = F.struct(F.col("day_open").alias("date"), F.lit(1).alias("n"), F.col(measure).alias("v"))
    after = F.struct(F.date_add("day_close", 1).alias("date"), F.lit(-1).alias("n"), (-F.col(measure)).alias("v"))
    moves = trades.select("algo_id", F.explode(F.array(first, after)).alias("m")).groupBy("algo_id", "m.date").agg(F.sum("m.n").alias("dn"), F.sum("m.v").alias("dv"))
    span = moves.groupBy("algo_id").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    calendar = days.agg(F.array_sort(F.collect_set("date")).alias("d"))  # one row, one date per day on record
    asked = with_single(span, calendar).select("algo_id", F.explode(F.filter("d", lambda x: (x >= F.col("a")) & (x < F.col("z")))).alias("date"), F.lit(True).alias("asked"))
    both = moves.unionByName(asked, allowMissingColumns=True).groupBy("algo_id", "date").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"), F.max("asked").alias("asked"))
    w = Window.partitionBy("algo_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("n", F.sum("dn").over(w)).withColumn("total", F.sum("dv").over(w))
    return run.filter("asked AND n > 0").select("date", "algo_id", "n", "total")


def rows_in_days(df: DataFrame, key: str, date: str, days: int, aggs: dict[str, Column]) -> DataFrame:
    """df with aggregates over the rows whose date lies in (date - days, date], by calendar days."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.col(date))).rangeBetween(-(days - 1), 0)
    return df.withColumns({n: a.over(w) for n, a in aggs.items()})


def rebalance_schedule(days: DataFrame, every: int) -> DataFrame:
    """(date): the first date, then always the first at least `every` calendar days after the last one taken.

    Each pick depends on the one before, so the calendar (one date per day on record) is folded as one array.
    """
    ordered = days.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("d"))
    none = F.array().cast("array<date>")

    def step(taken: Column, x: Column) -> Column:
        due = (F.size(taken) == 0) | (F.datediff(x, F.element_at(taken, -1)) >= every)
        return F.when(F.size(taken) == 0, F.array(x)).when(due, F.concat(taken, F.array(x))).otherwise(taken)

    return ordered.select(F.explode(F.aggregate("d", none, step)).alias("date"))


def overlapping(periods: DataFrame, windows: DataFrame, a: str, z: str, wa: str, wz: str, label: str, none: str) -> DataFrame:
    """periods with the label of every window that overlaps them, or `none`; windows is a short list (a row per split)."""
    w = windows.select(F.col(wa).alias("_wa"), F.col(wz).alias("_wz"), F.col(label))
    hit = F.greatest(F.col(a), F.col("_wa")) <= F.least(F.col(z), F.col("_wz"))
    return periods.join(F.broadcast(w), hit, "left").withColumn(label, F.coalesce(label, F.lit(none))).drop("_wa", "_wz")
