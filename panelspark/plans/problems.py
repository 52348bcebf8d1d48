"""Queries on the dealt data-processing problems 1 to 6, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, intervals, parse_lines, rolling, spikes, stamps
from ..sources.tables import join_dimension, one_per_key, table

#: A trade without a closing date is held until then (UTC).
HELD_UNTIL = "2025-06-30 00:00:00"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.continuous_periods(table(spark, d, "trades"), "algo_id", "date_open", "date_close", open_until=HELD_UNTIL)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("algo_id", "kind", text("from_ts"), text("to_ts"))


def _stamps(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    s = table(spark, d, "stamps").withColumn("stamp", F.coalesce("datetime", "gmt_time", "ts_event"))
    return s, {"key": "stamp_id", "file": "file_name", "stamp": "stamp", "zone": "zone_name", "epoch": F.col("ts_event").isNotNull(), "arrival": "loaded_at", "line": "line_no"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s, how = _stamps(spark, d)
    out = stamps.normalise(s, **how, zones=("UTC",))  # a file that names no zone is in UTC, as the data's statement has it
    return out.select(F.col("key").alias("stamp_id"), F.date_format("utc", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("utc"))


def p2_conventions(spark: SparkSession, d: str) -> DataFrame:
    """Per file the estimated day-month order and zone, out of several zones, with the violations that remain."""
    s, how = _stamps(spark, d)
    zones = ("UTC", "Europe/London", "Europe/Madrid", "America/New_York", "America/Chicago", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney")
    return stamps.estimate_conventions(stamps.parse(s, **how), zones).select(F.col("file").alias("file_name"), "month_first", "zone", "violations")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _implausible(spark, d).select("tab", "rec_id").distinct()


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _implausible(spark, d).distinct()


def _implausible(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "ohlc").select(F.col("file_id").alias("source"), "ts", F.col("bar_id").alias("rec_id"), F.col("close").alias("value"))
    ends = table(spark, d, "trim_info").select(F.col("file_id").alias("source"), F.col("trim_id").alias("rec_id"), F.col("death_price").alias("value"))
    return spikes.implausible(bars, ends)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines.failing_lines(table(spark, d, "csv_lines")).select("line_id", "reason").distinct()


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = parse_lines.load_rows(table(spark, d, "csv_lines"))
    return rows.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.trailing(table(spark, d, "algo_returns"), "algo_id", "date", "ret", arrival="loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "algo_features").select("algo_id", F.col("date").cast("date").alias("day"), "rolling_sharpe_21d", "rolling_return_63d")
    both = stored.join(_rolling(spark, d).select("algo_id", "day", "sharpe", "compound"), ["algo_id", "day"], "left")
    wrong = rolling.differs(F.col("rolling_sharpe_21d"), F.col("sharpe"), 0.001) | rolling.differs(F.col("rolling_return_63d"), F.col("compound"), 0.001)
    return both.filter(wrong).select("algo_id", F.date_format("day", "yyyy-MM-dd").alias("day")).distinct()


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = _rolling(spark, d)
    r = lambda c, n=9: (F.round(c, n) + 0.0).alias(c)
    return out.select("algo_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r("total_7"), r("mean_7"), r("total_30"), r("mean_30"), r("sharpe", 6), r("compound"))


def _ohlc_grid(spark: SparkSession, d: str) -> DataFrame:
    files = one_per_key(table(spark, d, "price_files").select("file_id", "step_minutes", "sessions"), ["file_id"]).filter("step_minutes > 0")
    bars = table(spark, d, "ohlc").select("file_id", "ts", "bar_id", "close").filter("close IS NOT NULL")
    placed = join_dimension(bars, files, "file_id")
    weekdays = F.col("sessions") == "24x5"
    placed = placed.withColumn("weekdays", F.coalesce(weekdays, F.lit(False)))
    placed = placed.withColumn("slot", grid.slot_number(F.col("ts"), F.col("step_minutes"), F.col("weekdays")))
    placed = placed.withColumn("next_slot", F.when(F.col("weekdays"), grid.next_slot_number(F.col("ts"), F.col("step_minutes"))))
    return grid.regular_grid(placed, ["file_id", "step_minutes", "weekdays"], "slot", "close", ["ts", "bar_id"], off_grid="next_slot").withColumn("start", grid.slot_start(F.col("slot"), F.col("step_minutes"), F.col("weekdays")))


def _panel_grid(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "algo_returns").filter("close IS NOT NULL").withColumn("ts", F.col("date").cast("timestamp"))
    r = r.withColumn("slot", grid.slot_number(F.col("ts"), F.lit(1440), F.lit(True)))
    r = r.withColumn("next_slot", grid.next_slot_number(F.col("ts"), F.lit(1440)))
    return grid.regular_grid(r, ["algo_id"], "slot", "close", ["loaded_at"], off_grid="next_slot").withColumn("start", grid.slot_start(F.col("slot"), F.lit(1440), F.lit(True)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    a = _ohlc_grid(spark, d).filter("state <> 'reading'")
    b = _panel_grid(spark, d).filter("state <> 'reading'")
    a = a.select(F.lit("ohlc").alias("tab"), F.col("file_id").cast("string").alias("source_key"), F.date_format("start", "yyyy-MM-dd HH:mm").alias("slot"))
    b = b.select(F.lit("algo_returns").alias("tab"), F.col("algo_id").alias("source_key"), F.date_format("start", "yyyy-MM-dd").alias("slot"))
    return a.unionByName(b)


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with readings, filled values and marked gaps."""
    a = _ohlc_grid(spark, d).select(F.lit("ohlc").alias("tab"), F.col("file_id").cast("string").alias("source_key"), "start", "value", "state")
    b = _panel_grid(spark, d).select(F.lit("algo_returns").alias("tab"), F.col("algo_id").alias("source_key"), "start", "value", "state")
    both = a.unionByName(b)
    return both.select("tab", "source_key", F.date_format("start", "yyyy-MM-dd HH:mm").alias("slot"), (F.round("value", 6) + 0.0).alias("value"), "state")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_conventions, p3_found, p3_reasons, p4_found, p4_rows, p5_found, p5_rolling, p6_found, p6_grid)}
