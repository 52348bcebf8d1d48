"""Shared inputs of the panel queries, as DataFrames and as SQL common table expressions, and the registration helper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import one_per_key, table
from .days import as_text

#: The panel: one row per algorithm and day with a return. An algorithm has at most one row a day, so its rows are bounded by the calendar.
PANEL = """panel AS (
  SELECT algo_id, CAST(date AS DATE) AS date, max(close) AS close, max(ret) AS ret FROM algo_returns
  WHERE algo_id IS NOT NULL AND date IS NOT NULL GROUP BY algo_id, CAST(date AS DATE) HAVING max(ret) IS NOT NULL
)"""
#: The panel in order, with row number, equity, running peak and drawdown.
ENRICHED = (
    PANEL
    + """, e0 AS (
  SELECT *, row_number() OVER w AS rn, product(1 + ret) OVER (w ROWS UNBOUNDED PRECEDING) AS p FROM panel WINDOW w AS (PARTITION BY algo_id ORDER BY date)
), e1 AS (SELECT *, max(p) OVER (PARTITION BY algo_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM e0),
enriched AS (SELECT *, CASE WHEN peak > 0 THEN p / peak - 1 ELSE 0 END AS dd FROM e1)"""
)
#: The market: the mean return of all algorithms by day.
MARKET = PANEL + ", market AS (SELECT date, avg(ret) AS ret, count(*) AS n_algos FROM panel GROUP BY date)"
#: Trades, repeated rows once.
TRADES = "t AS (SELECT DISTINCT trade_id, algo_id, date_open, date_close, volume, invested, equity_eod, aum, equity_normalized FROM trades)"
#: Trades whose dates are in order: no opening, no row; no closing, the greatest closing of all; closing before opening, the opening.
CLEAN = (
    TRADES
    + """, mx AS (SELECT CAST(max(date_close) AS DATE) AS d FROM t WHERE date_open IS NOT NULL),
clean AS (
  SELECT trade_id, algo_id, CAST(date_open AS DATE) AS day_open, greatest(CAST(date_open AS DATE), coalesce(CAST(date_close AS DATE), mx.d)) AS day_close,
    date_open, date_close, volume, invested, equity_eod, aum, equity_normalized
  FROM t, mx WHERE date_open IS NOT NULL AND algo_id IS NOT NULL
)"""
)
#: One family label per algorithm, case and blanks not counting.
FAMILIES = "fam AS (SELECT algo_id, min(lower(trim(family))) AS family FROM families WHERE algo_id IS NOT NULL AND family IS NOT NULL GROUP BY algo_id)"
#: Daily bars of each price file.
BARS = """bars AS (
  SELECT file_id, CAST(ts AS DATE) AS date, arg_min(open, (ts, bar_id)) AS open, max(high) AS high, min(low) AS low, arg_max(close, (ts, bar_id)) AS close, count(*) AS n
  FROM (SELECT DISTINCT bar_id, file_id, ts, open, high, low, close FROM ohlc WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close > 0)
  GROUP BY file_id, CAST(ts AS DATE)
)"""

#: Prices and trades of the order tables, where trades and prices share their keys: the algorithm is the customer's nation.
NATION_PRICES = """px AS (
  SELECT 'N' || c.c_nationkey AS algo_id, CAST(o.o_orderdate AS DATE) AS date, avg(o.o_totalprice) AS close FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY ALL
), panel AS (SELECT algo_id, date, close, close / lag(close) OVER (PARTITION BY algo_id ORDER BY date) - 1 AS ret FROM px QUALIFY ret IS NOT NULL)"""
NATION_TRADES = """clean AS (
  SELECT o.o_orderkey AS trade_id, 'N' || c.c_nationkey AS algo_id, CAST(o.o_orderdate AS DATE) AS day_open, greatest(CAST(o.o_orderdate AS DATE), CAST(max(l.l_shipdate) AS DATE)) AS day_close, sum(l.l_quantity) AS volume, sum(l.l_extendedprice) AS invested
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY o.o_orderkey, c.c_nationkey, o.o_orderdate
)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "algo_returns").select("algo_id", F.col("date").cast("date").alias("date"), "close", "ret")
    r = r.filter("algo_id IS NOT NULL AND date IS NOT NULL").groupBy("algo_id", "date").agg(F.max("close").alias("close"), F.max("ret").alias("ret"))
    return r.filter("ret IS NOT NULL")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey")).alias("algo_id"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


def nation_prices(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).groupBy("algo_id", "date").agg(F.avg("o_totalprice").alias("close"))


def nation_panel(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.panel import simple_returns

    return simple_returns(nation_prices(spark, d), "algo_id").drop("log_ret").filter("ret IS NOT NULL")


def nation_trades(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("z"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("invested"))  # noqa: E741
    j = _orders(spark, d).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_orderkey").alias("trade_id"), "algo_id", F.col("date").alias("day_open"), F.greatest("date", "z").alias("day_close"), "volume", "invested")


def market(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).groupBy("date").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("n_algos"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trades").drop("loaded_at").distinct()


def families(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "families").filter("algo_id IS NOT NULL AND family IS NOT NULL")
    return f.groupBy("algo_id").agg(F.min(F.lower(F.trim("family"))).alias("family"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.panel import daily_bars

    o = table(spark, d, "ohlc").drop("loaded_at", "algo_id").filter("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close > 0")
    return daily_bars(one_per_key(o, ["bar_id"]), "file_id", tie="bar_id")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df for comparison across engines: doubles rounded without negative zeros, days and instants as text."""

    def plain(c: str, kind: str) -> Column:
        if kind == "double":
            return (F.round(c, digits) + F.lit(0.0)).alias(c)
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if kind == "timestamp" else F.col(c)

    return df.select(*(plain(c, kind) for c, kind in df.dtypes))


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, digits: int = 6, name: str | None = None):
        """Registers a function under its name; its doubles come out rounded, its days and instants as text."""

        def add(f):
            key = name or f.__name__
            self.queries[key] = lambda spark, d: rounded(f(spark, d), digits)
            if sql:
                self.sql[key] = as_text(key, sql)
            return f

        return add


def safe_div(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)
