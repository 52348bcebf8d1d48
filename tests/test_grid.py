import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators.grid import next_slot_number, regular_grid, slot_number, slot_start

SCHEMA = "src string, slot long, v double, ts long, k long, shard long, own boolean, state string"


def pchip(xs, ys, x):
    """Monotone cubic through (xs, ys) at x, from the definition."""
    n = len(xs)
    if n == 2:
        return ys[0] + (ys[1] - ys[0]) * (x - xs[0]) / (xs[1] - xs[0])
    h, d = np.diff(xs).astype(float), np.diff(ys) / np.diff(xs)

    def end(h0, h1, d0, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(m) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(m) > 3 * abs(d0) else m

    m = np.zeros(n)
    for i in range(1, n - 1):
        if d[i - 1] * d[i] > 0:
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w0 + w1) / (w0 / d[i - 1] + w1 / d[i])
    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = int(np.searchsorted(xs, x, "right")) - 1
    t = (x - xs[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * ys[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * ys[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]


def run(spark, rows, **how):
    df = spark.createDataFrame([(s, k, v, t, 7, 7, True, "x") for s, k, v, t in rows], SCHEMA)
    out = regular_grid(df, ["src"], "slot", "v", ["ts"], **how).collect()
    assert len({(r["src"], r["slot"]) for r in out}) == len(out)
    return {(r["src"], r["slot"]): (r["value"], r["state"]) for r in out}


@pytest.mark.parametrize("shard", [1, 3, 16, 4096])
def test_against_definition(spark, shard):
    rng = random.Random(1)
    rows, known = [], {}
    for s in "ab":
        k = -40
        for _ in range(60):
            k += rng.choice([1, 1, 1, 2, 3, 6, 30])
            known.setdefault(s, {})[k] = rng.gauss(0, 1)
            rows += [(s, k, known[s][k], 2), (s, k, 99.0, 1), (s, k, known[s][k], 2)]
    got = run(spark, rows + [(None, 1, 1.0, 1), ("a", None, 1.0, 1), ("a", 500, None, 1)], max_gap=5, shard_slots=shard)
    for s, pts in known.items():
        xs = np.array(sorted(pts))
        assert {k for a, k in got if a == s} == set(range(xs[0], xs[-1] + 1))
        segments = np.split(xs, np.flatnonzero(np.diff(xs) - 1 > 5) + 1)
        for k in range(xs[0], xs[-1] + 1):
            value, state = got[(s, k)]
            seg = next((g for g in segments if g[0] <= k <= g[-1]), None)
            if k in pts:
                assert (value, state) == (pts[k], "reading")
            elif seg is None:
                assert (value, state) == (None, "gap")
            else:
                assert state == "filled" and value == pytest.approx(pchip(seg, np.array([pts[x] for x in seg]), k), abs=1e-12)


def test_one_reading_and_empty(spark):
    assert run(spark, [("a", 5, 1.0, 1)]) == {("a", 5): (1.0, "reading")}
    assert run(spark, []) == {}


def test_long_hole_in_blocks(spark):
    got = run(spark, [("a", 0, 1.0, 1), ("a", 100, 2.0, 1)], max_gap=5, shard_slots=8)
    assert len(got) == 101 and sum(s == "gap" for _, s in got.values()) == 99


def test_slots_and_back(spark):
    t0 = datetime(2024, 2, 26, 0, 0)  # a Monday
    rows = [(t0 + timedelta(minutes=37 * i), step, wk) for i in range(400) for step in (60, 240, 1440) for wk in (True, False)] + [(datetime(1969, 12, 31, 23, 59), 60, False)]
    df = spark.createDataFrame(rows, "ts timestamp, step int, wk boolean")
    n = slot_number(F.col("ts"), F.col("step"), F.col("wk"))
    for r in df.withColumn("n", n).withColumn("start", slot_start(n, F.col("step"), F.col("wk"))).collect():
        if r["wk"] and r["ts"].weekday() >= 5:
            assert r["n"] is None
        else:
            floor = r["ts"] - timedelta(minutes=(r["ts"].hour * 60 + r["ts"].minute) % r["step"], seconds=r["ts"].second)
            assert r["start"] == floor
    week = df.filter("wk AND step = 1440").select(n.alias("n")).distinct().orderBy("n").collect()
    got = [r["n"] for r in week if r["n"] is not None]
    assert got == list(range(got[0], got[0] + len(got)))


def test_readings_off_the_grid_bound_it(spark):
    """Weekend readings of a weekday grid: from Saturday 2024-03-02 the Monday counts, up to a Sunday the Friday before."""
    days = [("a", "2024-03-02"), ("a", "2024-03-06"), ("a", "2024-03-10"), ("b", "2024-03-09"), ("c", "2024-03-04"), ("c", "2024-03-09")]
    df = spark.createDataFrame([(s, datetime.fromisoformat(x), 1.0) for s, x in days * 2], "src string, t timestamp, v double")
    df = df.withColumn("n", slot_number(F.col("t"), F.lit(1440), F.lit(True))).withColumn("nx", next_slot_number(F.col("t"), F.lit(1440)))
    for shard in (2, 4096):
        out = regular_grid(df, ["src"], "n", "v", ["t"], shard_slots=shard, off_grid="nx")
        rows = out.withColumn("d", F.date_format(slot_start(F.col("slot"), F.lit(1440), F.lit(True)), "MM-dd")).collect()
        got = {(r["src"], r["d"]): r["state"] for r in rows}
        assert len(got) == len(rows)
        assert got == {("a", "03-06"): "reading", ("c", "03-04"): "reading"} | {("a", x): "gap" for x in ("03-04", "03-05", "03-07", "03-08")} | {("c", f"03-0{i}"): "gap" for i in range(5, 9)}
