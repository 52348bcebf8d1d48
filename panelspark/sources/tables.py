"""Table scans of a directory of parquet tables, and helpers on keys and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a dimension is broadcast; checked by adding up at most this many rows, never assumed.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name`; wall-clock timestamps become UTC instants (the session zone is pinned to UTC)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def within(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows and about `size` bytes; reads no more than rows + 1 of them."""

    def width(c: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if kind.startswith(("array", "map", "struct")) else F.lit(8)

    total = reduce(lambda a, b: a + b, (width(c, kind).cast("long") for c, kind in df.dtypes))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= rows and held <= size


def with_single(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a DataFrame of exactly one row, by a scalar subquery."""
    row = one.select(F.struct(*one.columns).alias("_one")).scalar()
    out = df.withColumn("_one", row)
    return out.withColumns({c: F.col("_one")[c] for c in one.columns}).drop("_one")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: filters on it stay above, its inputs are not written out into it."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def join_dimension(big: DataFrame, dim: DataFrame, on: str, how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """big joined with a table that has one row per key.

    A dimension of at most `rows` rows and BROADCAST_BYTES bytes (added up) is broadcast. A larger one is joined by
    shuffle with `salts` copies of each of its rows, so that no key of `big` meets in one task. Null keys of `big`
    match nothing.
    """
    if small(dim, rows):
        return big.join(F.broadcast(dim), on, how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    tossed = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return tossed.join(salted, [on, "_salt"], how).drop("_salt")


def one_per_key(df: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """One row per key: the one with the greatest `order`, by default with the greatest values of all other columns.

    Aggregates on the map side, so copies of a hot key shrink before the shuffle. Null is a key like any other.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*(c.alias(f"_order{i}") for i, c in enumerate(order or [])), *rest)
    picked = df.groupBy(*keys).agg(F.max(row).alias("_row"))
    return picked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)
