import random
from datetime import datetime, timedelta

import pytest

from panelspark.operators.intervals import continuous_periods

T0 = datetime(2020, 1, 1)
SCHEMA = "algo_id string, date_open timestamp, date_close timestamp, kind string, s long, k long"


def brute(rows, until):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((o, c or until) for k, o, c, *_ in rows if k == key and o and (c or until) and (c or until) >= o)
        merged = []
        for o, c in iv:
            if merged and o <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], c)
            else:
                merged.append([o, c])
        out += [(key, "period", a, z) for a, z in merged] + [(key, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    out = [tuple(r) for r in continuous_periods(df, "algo_id", "date_open", "date_close", **how).collect()]
    assert len(out) == len(set(out))
    return sorted(out)


@pytest.mark.parametrize("days", [1, 7, 400])
def test_against_brute_force(spark, days):
    rng = random.Random(days)
    rows = []
    for _ in range(600):
        o = T0 + timedelta(hours=rng.randrange(24 * 300))
        c = o + timedelta(hours=rng.choice([0, 0, 1, 5, 24, 24 * 40, -3]))
        rows.append((rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([o, o, o, o, None]), rng.choice([c, c, c, c, c, c, c, c, None])))
    rows += rows[:50]
    rows = [(k, o, c if c is not None or random.Random(str(o)).random() < 0.1 else c) for k, o, c in rows]
    until = datetime(2020, 9, 1)
    assert run(spark, rows, open_until="2020-09-01 00:00:00", shard_days=days) == brute(rows, until)


def test_touching_at_shard_boundaries_and_instants(spark):
    day = timedelta(days=1)
    rows = [("a", T0, T0 + day), ("a", T0 + day, T0 + day), ("a", T0 + day, T0 + 3 * day), ("a", T0 + 10 * day, T0 + 10 * day), ("b", T0 - 9 * day, T0 + 9 * day), ("b", T0, T0)]
    assert run(spark, rows, shard_days=1) == brute(rows, None) == run(spark, rows, shard_days=1000)


def test_open_ones_without_a_horizon_and_empty(spark):
    assert run(spark, [("a", T0, None), ("a", None, T0), (None, T0, T0), ("a", T0, T0 - timedelta(1))]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert continuous_periods(empty, "algo_id", "date_open", "date_close").collect() == []
