"""Scans of price-file directories, symbol selection, futures rolls, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.parse_lines import failing_lines, load_rows

# The delivery-month letters of futures.
MONTH_CODES = "FGHJKMNQUVXZ"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, file_name, line_no, line) of every line of the text files under a path or glob; lines end in a newline, a carriage return stays.

    Large files are read in splits: lines are numbered within each split, and the splits' line counts are added up per
    file. line_id depends on path and number only.
    """
    at = "_metadata.file_path", "_metadata.file_name", "_metadata.file_block_start"
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), *(F.col(c).alias(n) for c, n in zip(at, ("path", "file_name", "start"))), F.monotonically_increasing_id().alias("_m"))
    counts = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    before = counts.select("path", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = raw.withColumn("_r", F.row_number().over(Window.partitionBy("path", "start").orderBy("_m"))).join(before, ["path", "start"])
    lines = placed.withColumn("line_no", (F.col("before") + F.col("_r")).cast("int"))
    return lines.select(F.xxhash64("path", "line_no").alias("line_id"), "file_name", "line_no", "line")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(algo_id, file_name, bytes): the files under a path or glob, the id being the name without its ending; no file is read."""
    f = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(F.regexp_replace(name, r"\.[^.]*\z", "").alias("algo_id"), name.alias("file_name"), F.col("length").alias("bytes"))


def daily_price_files(spark: SparkSession, path: str, least_bytes: int = 50, least_lines: int = 2, least_rows: int = 10, least_days: int = 10) -> DataFrame:
    """(algo_id, date, open, high, low, close, n): daily bars of the price files under a path.

    Left out are files below least_bytes, least_lines lines after the header, least_rows rows that can be read, or
    least_days days. A row needs a datetime and a close; where a file has no open, high or low, or they cannot be read,
    close stands for them.
    """
    lines = text_lines(spark, path)
    floor = list_files(spark, path).filter(F.col("bytes") >= least_bytes).select("file_name").distinct()
    filled = lines.filter("line_no > 1 AND trim(line) <> ''").groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_lines).select("file_name")
    kept = lines.join(floor, "file_name", "left_semi").join(filled, "file_name", "left_semi")
    rows = load_rows(kept, ("open", "high", "low"))
    enough = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("datetime")).alias("days")).filter((F.col("n") >= least_rows) & (F.col("days") >= least_days)).select("file_name")
    at = F.struct("datetime", "line_no")
    price = lambda c: F.coalesce(c, "close")
    return rows.join(enough, "file_name", "left_semi").groupBy(F.regexp_replace("file_name", r"\.[^.]*\z", "").alias("algo_id"), F.to_date("datetime").alias("date")).agg(
        F.min_by(price("open"), at).alias("open"), F.max(price("high")).alias("high"), F.min(price("low")).alias("low"), F.max_by("close", at).alias("close"), F.count(F.lit(1)).alias("n")
    )


def price_files(spark: SparkSession, path: str, least_rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): algo_id, ts, close of the files with at least `least_rows` valid rows, and every failing line with its reason."""
    lines = text_lines(spark, path)
    rows = load_rows(lines).select(F.regexp_replace("file_name", r"\.csv\z", "").alias("algo_id"), F.col("datetime").alias("ts"), "close")
    enough = rows.groupBy("algo_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows).select("algo_id")
    return rows.join(enough, "algo_id", "left_semi"), failing_lines(lines)


def inspect(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, n, first, last, days): what there is of each source."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.countDistinct(F.col(ts).cast("date")).alias("days"))


def parse_by_majority(df: DataFrame, file: str, stamp: str, formats: list[str], most_failures: float = 0.5) -> DataFrame:
    """df with ts: per file the first format in which less than `most_failures` of its stamps fail; null where none does."""
    tries = [F.try_to_timestamp(F.col(stamp), F.lit(f)) for f in formats]
    rates = df.groupBy(file).agg(*(F.avg(t.isNull().cast("int")).alias(f"_f{i}") for i, t in enumerate(tries)))
    pick = reduce(lambda rest, i: F.when(F.col(f"_f{i}") < most_failures, i).otherwise(rest), reversed(range(len(formats))), F.lit(None).cast("int"))
    joined = df.join(rates.select(file, pick.alias("_pick")), file, "left")
    ts = reduce(lambda rest, i: F.when(F.col("_pick") == i, tries[i]).otherwise(rest), range(len(formats)), F.lit(None).cast("timestamp"))
    return joined.withColumn("ts", ts).drop("_pick")


def minute_bars(spark: SparkSession, path: str, name_pattern: str = r"DAT_ASCII_([A-Z0-9]+)_M1_") -> DataFrame:
    """(ticker, ts, open, high, low, close): `;`-separated yearly files of minute bars, of repeated minutes the first file's by name."""
    raw = spark.read.csv(path, sep=";", schema="stamp string, open double, high double, low double, close double, volume double")
    raw = raw.withColumn("_file", F.input_file_name()).withColumn("ticker", F.regexp_extract("_file", name_pattern, 1)).withColumn("ts", F.try_to_timestamp("stamp", F.lit("yyyyMMdd HHmmss")))
    bar = F.struct("open", "high", "low", "close")
    picked = raw.filter("ts IS NOT NULL AND ticker <> ''").groupBy("ticker", "ts").agg(F.min_by(bar, F.struct("_file", bar)).alias("b"))
    return picked.select("ticker", "ts", "b.*")


def top_by_mean(df: DataFrame, key: str, measure: str, n: int, least_rows: int = 1) -> DataFrame:
    """df of the n keys with the greatest mean of a measure, ties by key; keys with fewer rows are left out."""
    best = df.groupBy(key).agg(F.avg(measure).alias("_m"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_rows).orderBy(F.col("_m").desc_nulls_last(), key).limit(n)
    return df.join(F.broadcast(best.select(key)), key, "left_semi")  # n rows


def futures_root(symbol: Column) -> Column:
    """Root of an outright futures symbol; null for spreads and anything else."""
    pattern = rf"^([A-Z0-9]{{2,4}}?)([{MONTH_CODES}])(\d{{1,2}})\z"
    return F.when(symbol.rlike(pattern) & ~symbol.rlike("[-:]"), F.regexp_extract(symbol, pattern, 1))


def front_contracts(df: DataFrame, symbol: str, date: str, close: str, volume: str) -> DataFrame:
    """(root, date, symbol, close): per root and date the contract with the greatest volume and a positive close; ties by symbol."""
    x = df.withColumn("root", futures_root(F.col(symbol))).filter(F.col("root").isNotNull() & (F.col(close) > 0))
    best = F.max_by(F.struct(F.col(symbol).alias("symbol"), F.col(close).alias("close")), F.struct(volume, symbol))
    return x.groupBy("root", date).agg(best.alias("b")).select("root", date, "b.symbol", "b.close")


def narrowed(df: DataFrame) -> DataFrame:
    """df with whole numbers in the narrowest type that holds their range (one aggregate) and doubles as floats."""
    ints = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint")]
    lim = df.agg(*(F.max(F.abs(F.col(c).cast("long"))).alias(c) for c in ints)).first() if ints else {}
    fits = {c: next(t for t, most in (("tinyint", 127), ("smallint", 32767), ("int", 2**31 - 1), ("bigint", 2**63)) if (lim[c] or 0) <= most) for c in ints}
    return df.withColumns({**{c: F.col(c).cast(t) for c, t in fits.items()}, **{c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"}})


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet with zstd."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_trials(df: DataFrame, path: str) -> None:
    """Appends trial rows with the time of the append (_appended); readers see every append as one commit of files."""
    df.withColumn("_appended", F.current_timestamp()).write.mode("append").parquet(path)


def best_trials(spark: SparkSession, path: str, metric: str, n: int, key: str = "trial_id") -> DataFrame:
    """The n trials with the greatest metric, ties by key; of a trial's rows the last appended counts, of one append's the greatest metric."""
    w = Window.partitionBy(key).orderBy(F.col("_appended").desc_nulls_last(), F.col(metric).desc_nulls_last())
    t = spark.read.parquet(path).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_appended")
    return t.orderBy(F.col(metric).desc_nulls_last(), key).limit(n)


def write_text(df: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """CSV with a header, or one JSON object a line; nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
        df.withColumns(nested).write.mode(mode).option("header", True).csv(path)
    elif kind == "json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"no such kind of text: {kind}")
