"""What algorithms trade, against a plain computation; style weights by their optimality conditions."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import comovement as cm
from panelspark.operators import inference as inf

D0 = date(2023, 1, 2)
FRAME = "k string, date date, v double, n long, rn int"


def frames(spark, algos, benches):
    rows = lambda m: [(k, D0 + timedelta(days=i), v, 1, 2) for k, x in m.items() for i, v in x.items()]
    return spark.createDataFrame(rows(algos), FRAME), spark.createDataFrame(rows(benches), FRAME)


def series(seed, days, scale=0.01):
    rng = random.Random(seed)
    return {i: rng.gauss(0, scale) for i in days}


def p_of(r, n):
    """Two-sided, by integrating Student's density with the midpoint rule."""
    k = n - 2
    t = abs(r) * math.sqrt(k / max(1 - r * r, 1e-15))
    u = (np.arange(200_000) + 0.5) / 200_000 * math.atan(t / math.sqrt(k))  # x = sqrt(k) tan u
    area = np.cos(u) ** (k - 1)
    whole = (np.arange(200_000) + 0.5) / 200_000 * (math.pi / 2)
    return 1 - area.mean() * math.atan(t / math.sqrt(k)) / (np.cos(whole) ** (k - 1)).mean() / (math.pi / 2)


def test_inference_against_plain_computation(spark):
    days = range(150)
    b = {f"b{i}": series(i, days if i else range(0, 150, 2)) for i in range(5)}
    noise = series(99, days, 0.002)
    algos = {
        "one": {i: 0.9 * b["b1"][i] + noise[i] for i in days}, "two": {i: 0.7 * b["b2"][i] - 0.6 * b["b3"][i] + noise[i] for i in days}, "none": series(77, days), "short": {i: -b["b4"][i] for i in days}, "few": series(5, range(12)), "flat": dict.fromkeys(days, 0.0),
    }
    left, right = frames(spark, algos, b)
    pairs = spark.createDataFrame([(a, x) for a in algos for x in b], "a string, b string")
    signals = inf.deep_signals(pairs, left, right)
    classes = spark.createDataFrame([("b0", "fx"), ("b1", "equity"), ("b2", "equity"), ("b3", "fx")], "b string, asset_class string")
    got = {r["a"]: r for r in inf.infer(signals, classes, left, right).collect()}
    assert set(got) == set(algos) - {"few"}
    assert (got["one"]["best"], got["one"]["asset_class"], got["one"]["direction"], got["one"]["confidence"]) == ("b1", "equity", "long", 95)
    assert got["two"]["asset_class"] == "mixed" and got["two"]["label"] == "Mixed: b2 (equity) + b3 (fx)" and got["two"]["exposures"].startswith("b2:long,b3:short")
    assert (got["short"]["best"], got["short"]["direction"], got["short"]["label"]) == ("b4", "short/inverse", "b4 (?)")
    assert got["flat"]["asset_class"] in ("unknown",) and got["flat"]["confidence"] >= 5
    s = {(r["a"], r["b"]): r for r in signals.collect()}
    for a, x in (("one", "b1"), ("two", "b0"), ("none", "b4")):
        both = [i for i in algos[a] if i in b[x]]
        u, v = np.array([algos[a][i] for i in both]), np.array([b[x][i] for i in both])
        w = min(20, len(both) // 3)
        dd = lambda z: (c := np.cumprod(1 + z)) / np.maximum.accumulate(c) - 1
        vol = lambda z: np.array([z[i - w + 1 : i + 1].std(ddof=1) for i in range(w - 1, len(z))])
        rank = lambda z: np.argsort(np.argsort(z))
        c = lambda p, q: np.corrcoef(p, q)[0, 1]
        want = {"n_overlap": len(both), "pearson_r": c(u, v), "spearman_r": c(rank(u), rank(v)), "beta": np.cov(u, v)[0, 1] / v.var(), "dd_corr": c(dd(u), dd(v)), "vol_regime_corr": c(vol(u), vol(v)), "directional_agreement": (np.sign(u) == np.sign(v)).mean()}
        assert {k: s[(a, x)][k] for k in want} == pytest.approx(want, abs=1e-7)
    best = spark.createDataFrame([("two", "b2", 0.7)], "a string, best string, best_beta double")
    rest = {r["b"]: r for r in inf.residual_exposures(signals, best, left, right).collect()}
    assert "b3" in rest and "b2" not in rest
    for x, r in rest.items():
        assert r["p_value"] == pytest.approx(p_of(r["corr"], r["n"]), abs=1e-6) and abs(r["corr"]) > 0.1
    features = {(r["a"], r["feature"]): r["value"] for r in inf.priors(inf.infer(signals, classes, left, right)).collect()}
    assert features[("one", "prior_asset_equity")] == 1.0 and features[("one", "prior_direction_short_inverse")] == 0.0 and features[("none", "prior_asset_equity")] == 0.0 and features[("one", "prior_asset_confidence")] == 0.95
    assert inf.infer(signals.limit(0), classes, left, right).count() == 0


def test_style_weights_are_optimal():
    rng = np.random.default_rng(1)
    for case in range(12):
        x = rng.normal(0, 0.01, (80, 4))
        x[:, 3] = x[:, 2] if case % 3 == 0 else x[:, 3]  # two equal columns
        y = x @ rng.normal(0.4, 0.5, 4) + rng.normal(0, 0.004, 80)
        w = cm.style_weights(y, x)
        assert (w >= 0).all() and w.sum() <= 1 + 1e-9
        g = x.T @ (x @ w - y)  # lowest on the support, up to the price of the sum
        price = max(0.0, float(-g.min())) if w.sum() > 1 - 1e-7 else 0.0
        scale = np.abs(x.T @ y).max() + 1e-12
        assert (g + price >= -1e-4 * scale).all() and (np.abs((g + price)[w > 1e-6]) < 1e-4 * scale).all()


def test_style_regression_of_rows(spark):
    days = range(60)
    b = {"b0": series(1, days), "b1": series(2, days)}
    left, right = frames(spark, {"a": {i: 0.3 * b["b0"][i] + 0.5 * b["b1"][i] for i in days}, "short": series(3, range(20))}, b)
    pairs = spark.createDataFrame([(a, x) for a in ("a", "short", "absent") for x in b] * 2, "a string, b string")
    got = {r["b"]: r for r in cm.style_regression(left, right, pairs).collect()}
    assert set(got) == {"b0", "b1"} and got["b0"]["exposure_pct"] == pytest.approx(30, abs=1e-3) and got["b1"]["r_squared"] == pytest.approx(1, abs=1e-6) and got["b0"]["unexplained_pct"] == pytest.approx(20, abs=1e-3)


def test_covariance_is_raised_to_be_positive(spark):
    rows = [(k, D0 + timedelta(days=i), float(v)) for i in range(30) for k, v in (("x", i % 3), ("y", i % 3), ("z", -(i % 3)))]
    df = spark.createDataFrame(rows, "algo_id string, date date, ret double")
    m = np.zeros((3, 3))
    for r in cm.shrunk_covariance(df, shrinkage=0.0).collect():
        i, j = "xyz".index(r["a"]), "xyz".index(r["b"])
        m[i, j] = m[j, i] = r["cov"]
    assert np.linalg.eigvalsh(m)[0] == pytest.approx(1e-8, abs=1e-9) and m[0, 1] == pytest.approx(np.var([i % 3 for i in range(30)], ddof=1))
    assert cm.shrunk_covariance(df.limit(0)).count() == 0
