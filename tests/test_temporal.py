import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.operators.features import activity_gaps, filled_and_interpolated
from panelspark.operators.temporal import asof_join

T0 = datetime(2020, 1, 1)


def brute(left, right, back, strict):
    out = {}
    for i, k, t in left:
        hits = [(u, v) for kk, u, v in right if kk is not None and kk == k and t is not None and u is not None and ((u < t or (u == t and not strict)) if back else (u > t or (u == t and not strict)))]
        best = (max if back else min)((u for u, _ in hits), default=None)
        out[i] = max((v for u, v in hits if u == best), default=None)
    return out


@pytest.mark.parametrize("days", [1, 7, 10_000])
def test_asof_against_brute_force(spark, days):
    rng = random.Random(days)
    t = lambda: T0 + timedelta(hours=6 * rng.randrange(400))
    left = [(i, rng.choice(["a", "b", "c", None]), t() if rng.random() > 0.05 else None) for i in range(300)]
    right = [(rng.choice(["a", "b", None]), t() if rng.random() > 0.05 else None, rng.randrange(1000)) for _ in range(60)]
    ld = spark.createDataFrame([(*x, -1, "x") for x in left], "id long, k string, t timestamp, _t long, _block string")
    rd = spark.createDataFrame(right, "k string, u timestamp, v long")
    for back in (True, False):
        for strict in (True, False):
            got = asof_join(ld, rd, ["k"], "t", "u", ["v"], "backward" if back else "forward", strict=strict, block_days=days).collect()
            assert len(got) == len(left) and {r["id"]: r["v"] for r in got} == brute(left, right, back, strict)
    both = {r["id"]: (r["v"], r["v_or_first"]) for r in asof_join(ld, rd, ["k"], "t", "u", ["v"], fallback="both", block_days=days).collect()}
    first = {k: min(((u, -v) for kk, u, v in right if kk == k and u is not None)) for k in ("a", "b")}
    for i, k, at in left:
        v = brute([(i, k, at)], right, True, False)[i]
        assert both[i] == (v, v if v is not None or k not in first or at is None else -first[k][1])
    assert asof_join(ld.limit(0), rd, ["k"], "t", "u", ["v"]).count() == 0
    assert {r["v"] for r in asof_join(ld, rd.limit(0), ["k"], "t", "u", ["v"]).collect()} == {None}


def test_one_hot_key(spark):
    """Half a million rows of one key, both directions; a frame that looks ahead from every row would take hours."""
    n = 500_000
    left = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 700 + 350).alias("t"))
    right = spark.range(1000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 350_000).alias("u"), F.col("id").alias("v"))
    begin = time.time()
    for direction, last in (("backward", 999), ("forward", None)):
        out = asof_join(left, right, ["k"], "t", "u", ["v"], direction)
        row = out.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.max(F.struct("t", "v")).alias("m")).first()
        assert row["n"] == n and row["m"]["v"] == last
        assert row["s"] == sum((i * 700 + 350) // 350_000 + (direction == "forward") for i in range(n) if direction == "backward" or i * 700 + 350 <= 349_650_000)
    assert time.time() - begin < 120


def test_gaps_and_fills_look_ahead(spark):
    rng = random.Random(2)
    rows = [("a" if i % 2 else "b", (T0 + timedelta(days=i)).date(), i, rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame([(k, d, p, float(i) ** 2 if p else None) for k, d, i, p in rows], "algo_id string, date date, present boolean, v double")
    gaps = {(r["algo_id"], r["date"]): (r["since_last"], r["until_next"]) for r in activity_gaps(df).collect()}
    fill = {(r["algo_id"], r["date"]): (r["ffill"], r["bfill"]) for r in filled_and_interpolated(df, "v").collect()}
    for k, d, _, _ in rows:
        seen = [(x, i) for kk, x, i, p in rows if kk == k and p]
        before, after = [s for s in seen if s[0] <= d], [s for s in seen if s[0] >= d]
        assert gaps[(k, d)] == ((d - before[-1][0]).days if before else None, (after[0][0] - d).days if after else None)
        assert fill[(k, d)] == (float(before[-1][1]) ** 2 if before else None, float(after[0][1]) ** 2 if after else None)
