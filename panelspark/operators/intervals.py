"""Overlapping, nested and gapped intervals per entity: continuous periods and the gaps between them.

Two-level merge. Time is cut into shards. An interval leaves a piece in its first and its last shard and one span
over the shards between, so a long interval costs three rows at most. Pieces merge within (entity, shard); only
coverage that touches a shard boundary is stitched per entity, at most two pieces a shard. No task ever holds the
intervals of a whole entity, only those of one of its shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _floor_div(x: Column, w: int) -> Column:
    return ((x - F.pmod(x, F.lit(w))) / F.lit(w)).cast("long")


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Closed intervals (s, e) coalesced within keys: those that share a point become one."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    island = F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    flagged = df.withColumn("_open", opened).withColumn("_island", island)
    return flagged.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def continuous_periods(df: DataFrame, key: str, start: str, end: str, open_until: str | None = None, shard_days: int = 32) -> DataFrame:
    """(key, kind, from_ts, to_ts): the maximal periods covered by an entity's intervals and the gaps between successive ones.

    Both ends belong to an interval, so touching intervals form one period and an interval may last no time. A null
    end means held until `open_until` (UTC; such a row is left out if that is None). Rows with a null key or start, or
    that end before they start, give nothing. Repeated rows and ties change nothing; an empty table gives an empty
    result; other columns are not looked at. shard_days sets the shard width: choose it so that the intervals of the
    busiest entity in one shard fit a task.
    """
    w = shard_days * DAY_US
    until = F.unix_micros(F.lit(open_until).cast("timestamp")) if open_until else F.lit(None).cast("long")
    iv = df.select(
        F.col(key).alias("_key"),
        F.unix_micros(F.col(start).cast("timestamp")).alias("s"),
        F.coalesce(F.unix_micros(F.col(end).cast("timestamp")), until).alias("e"),
    ).filter("_key IS NOT NULL AND s IS NOT NULL AND e >= s")
    first, last = _floor_div(F.col("s"), w), _floor_div(F.col("e"), w)
    iv = iv.withColumn("k0", first).withColumn("k1", last)

    def part(span: bool, k: Column, s: Column, e: Column) -> Column:
        return F.struct(F.lit(span).alias("span"), k.alias("k"), s.alias("s"), e.alias("e"))

    k0, k1, wide = F.col("k0"), F.col("k1"), F.lit(w)
    parts = F.array(
        part(False, k0, F.col("s"), F.least(F.col("e"), (k0 + 1) * wide)),
        F.when(k1 > k0, part(False, k1, k1 * wide, F.col("e"))),
        F.when(k1 > k0 + 1, part(True, k0 + 1, (k0 + 1) * wide, k1 * wide)),
    )
    cut = iv.select("_key", F.explode(F.array_compact(parts)).alias("p")).select("_key", "p.*")
    cut = cut.groupBy("_key", "span", "k", "s").agg(F.max("e").alias("e"))  # one row per start, combined before the shuffle

    pieces = cut.filter("NOT span").select("_key", "k", "s", "e")
    spans = _merge(cut.filter("span").select("_key", "s", "e"), ["_key"])  # at most one row per shard and entity
    shards = F.sequence(_floor_div(F.col("s"), w), _floor_div(F.col("e"), w) - 1)
    full = spans.select("_key", F.explode(shards).alias("k")).select("_key", "k", (F.col("k") * wide).alias("s"), ((F.col("k") + 1) * wide).alias("e"))
    local = _merge(pieces.unionByName(full), ["_key", "k"])

    # Coverage that touches no boundary keeps its shard as its group; the rest of an entity is one group, two rows a shard at most.
    touches = (F.col("s") == F.col("k") * wide) | (F.col("e") == (F.col("k") + 1) * wide)
    grouped = local.withColumn("g", F.when(touches, F.lit(None).cast("long")).otherwise(F.col("k"))).drop("k")
    periods = _merge(grouped, ["_key", "g"]).select("_key", _floor_div(F.col("s"), w).alias("k"), "s", "e")

    # The next period: within the shard, else the first one of the next shard that has any, placed as a marker row.
    firsts = periods.groupBy("_key", "k").agg(F.min("s").alias("s"))
    nxt = F.lead("s").over(Window.partitionBy("_key").orderBy("k"))
    markers = firsts.select("_key", "k", nxt.alias("s")).filter("s IS NOT NULL").withColumn("e", F.lit(None).cast("long"))
    follow = F.lead("s").over(Window.partitionBy("_key", "k").orderBy("s"))
    seen = periods.unionByName(markers).withColumn("n", follow).filter("e IS NOT NULL")
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("f"), F.col("e").alias("t")),
        F.when(F.col("n").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("e").alias("f"), F.col("n").alias("t"))),
    )
    out = seen.select("_key", F.explode(F.array_compact(rows)).alias("r"))
    return out.select(F.col("_key").alias(key), "r.kind", F.timestamp_micros("r.f").alias("from_ts"), F.timestamp_micros("r.t").alias("to_ts"))
