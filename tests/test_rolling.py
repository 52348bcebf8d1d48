import math
import random
from datetime import date, timedelta

import numpy as np

from panelspark.operators.rolling import differs, trailing
from pyspark.sql import functions as F

SCHEMA = "algo_id string, date date, ret double, loaded_at timestamp, key string, day string, v double, block long"


def run(spark, rows):
    df = spark.createDataFrame([(a, d, r, None, "k", "d", 9.0, 1) for a, d, r in rows], SCHEMA)
    return {(r["algo_id"], r["day"]): r for r in trailing(df, "algo_id", "date", "ret", "loaded_at").collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for a in "ab":
        for i in range(700):
            if rng.random() < 0.6:
                rows.append((a, date(2020, 1, 1) + timedelta(days=i), rng.choice([None, 0.0, -1.0] + [rng.gauss(0, 0.01)] * 40)))
    rows += [("flat", date(2021, 1, 1) + timedelta(days=i), 0.05) for i in range(80)] + rows[:30] + [(None, date(2020, 1, 1), 1.0), ("x", None, 1.0)]
    got = run(spark, rows)
    seen = 0
    for a in ("a", "b", "flat"):
        by = {d: r or 0.0 for k, d, r in rows if k == a}
        days = [min(by) + timedelta(days=i) for i in range((max(by) - min(by)).days + 1)]
        v = np.array([by.get(d, 0.0) for d in days])
        for i, d in enumerate(days):
            r = got[(a, d)]
            seen += 1
            for w in (7, 30):
                assert math.isclose(r[f"total_{w}"], v[max(0, i - w + 1) : i + 1].sum(), abs_tol=1e-12)
                assert math.isclose(r[f"mean_{w}"], v[max(0, i - w + 1) : i + 1].sum() / w, abs_tol=1e-12)
            if i < 20:
                assert r["sharpe"] is None
            else:
                x = v[i - 20 : i + 1]
                assert math.isclose(r["sharpe"], 0 if x.std() <= 1e-10 else x.mean() / x.std() * 252**0.5, rel_tol=1e-9, abs_tol=1e-9)
            assert (r["compound"] is None) == (i < 62)
            if i >= 62:
                assert math.isclose(r["compound"], np.prod(1 + v[i - 62 : i + 1]) - 1, abs_tol=1e-12)
    assert len(got) == seen


def test_single_day_and_empty(spark):
    got = run(spark, [("a", date(2020, 1, 1), None)])
    assert len(got) == 1 and got[("a", date(2020, 1, 1))]["total_7"] == 0.0
    assert run(spark, []) == {}


def test_differs(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 1.0005D), (1D, 1.002D), (NULL, 1D), (1D, NULL), (NULL, NULL), (double('nan'), NULL) AS t(a, b)")
    assert [r[0] for r in df.select(differs(F.col("a"), F.col("b"), 0.001)).collect()] == [False, True, True, True, False, False]
