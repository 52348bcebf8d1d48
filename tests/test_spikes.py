from datetime import datetime, timedelta

import numpy as np
import pytest

from panelspark.operators import spikes as sp

R = "source long, ts timestamp, rec_id long, value double, chunk int, n long, kind int"
E = "source long, rec_id long, value double, chunk int, ts timestamp"
T0 = datetime(2020, 1, 1)


def series(n, seed, move=0.004):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, move, n)))


def run(spark, files, ends=(), chunk_rows=sp.CHUNK_ROWS, shuffle=3):
    rows = []
    for f, v in files.items():
        rows += [(f, T0 + timedelta(hours=i), (f or 0) * 100_000 + i, None if x is None else float(x), 9, 9, 9) for i, x in enumerate(v)]
    rng = np.random.default_rng(shuffle)
    rows += [rows[i] for i in rng.integers(0, max(len(rows), 1), len(rows) // 20)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    out = sp.implausible(spark.createDataFrame(rows, R), spark.createDataFrame([(a, b, c, 9, None) for a, b, c in ends], E), chunk_rows=chunk_rows)
    got = [(r["tab"], r["rec_id"], r["reason"]) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def dirty(n, seed):
    v = series(n, seed)
    want = set()
    for i, f in ((n // 5, 1.3), (n // 3, 0.01), (n // 3 + 1, 0.01), (n // 2, 1000.0)):
        v[i] *= f
        want.add((i, "spike"))
    a = n * 7 // 10
    v[a : a + 15] = v[a]
    want |= {(i, "standstill") for i in range(a + 1, a + 15)}
    v[n // 4] = -3.0
    v[n // 6] = 0.0
    want |= {(n // 4, "range"), (n // 6, "range")}
    v[n * 4 // 5 :] *= 1.5  # a lasting change of level
    v[-20:] = v[-20]  # a standstill that lasts to the end
    return v, want


def test_planted_cases(spark):
    v, want = dirty(400, 1)
    w, _ = dirty(300, 2)
    got = run(spark, {1: v, 2: series(300, 3), 3: list(w) + [None, None]})
    assert {(i - 100_000, r) for t, i, r in got if t == "ohlc" and 100_000 <= i < 200_000} == want
    assert not {i for t, i, r in got if 200_000 <= i < 300_000}


@pytest.mark.parametrize("chunk", [150, 333, 1000])
def test_chunks_give_the_same(spark, chunk):
    v, want = dirty(3000, 7)
    v[1400:2100] = v[1400]  # a standstill over several chunks
    want = {(i, r) for i, r in want if not 1400 <= i < 2100} | {(i, "standstill") for i in range(1401, 2100)}
    got = run(spark, {1: v, 2: series(50, 3)}, chunk_rows=chunk)
    assert {(i - 100_000, r) for t, i, r in got} == want


def test_chunks_go_by_what_is_usual_in_the_whole_file(spark):
    """Volatility changes between chunks: the limit of ten usual moves is the file's, about 0.011 in 1 and 0.014 in 2."""
    step = lambda n, m, seed: np.log(zigzag(n, seed, m) / 100)
    files = {1: np.concatenate([step(1800, 0.0005, 1), step(1200, 0.002, 2)]), 2: np.concatenate([step(1200, 0.0005, 3), step(1800, 0.002, 4)])}
    for x in files.values():
        x[[500, 2500]] += 0.0135
    files = {f: 100 * np.exp(x) for f, x in files.items()}
    want = {("ohlc", 100_500, "spike"), ("ohlc", 102_500, "spike")}
    assert run(spark, files) == want
    assert run(spark, files, chunk_rows=300) == want


def test_chunks_by_rows_and_repeat_rate_of_the_whole_file(spark):
    """Readings crowd in time, and the first half repeats itself far more often than the second."""
    rng = np.random.default_rng(5)
    v = np.concatenate([np.round(series(1000, 1, 0.0006), 1), 100 * np.exp(np.cumsum(rng.normal(0, 0.004, 1000)))])
    v[1500:1509] = v[1500]
    v[1700] *= 1.2
    rows = [(1, T0 + timedelta(seconds=i if i < 1900 else i * 10_000), i, float(x), 9, 9, 9) for i, x in enumerate(v)]
    ends = spark.createDataFrame([(1, 1, float(v[-1]) * 1.01, 9, None), (1, 2, float(v[-1]) * 2, 9, None)], E)
    found = lambda k: {(r["tab"], r["rec_id"], r["reason"]) for r in sp.implausible(spark.createDataFrame(rows, R), ends, chunk_rows=k).collect()}
    whole = found(sp.CHUNK_ROWS)
    assert ("ohlc", 1700, "spike") in whole and ("trim_info", 2, "end") in whole
    assert found(250) == whole


def test_standstill_over_chunks_to_the_end_is_none(spark):
    v = series(2000, 9)
    v[900:] = v[900]
    assert run(spark, {1: v}, chunk_rows=200) == set()


def test_ends(spark):
    v = series(300, 4)
    last = float(v[-1])
    ends = [(1, 1, last), (1, 2, last * 3), (1, 3, -last), (1, 4, 0.0), (1, 5, None), (9, 6, 5.0), (9, 7, -5.0), (None, 8, 1.0)]
    assert {(t, i, r) for t, i, r in run(spark, {1: v}, ends)} == {("trim_info", 2, "end"), ("trim_info", 3, "range"), ("trim_info", 4, "range"), ("trim_info", 7, "range")}


def test_quantised_prices_stand_still_now_and_then(spark):
    v = np.round(series(500, 5, 0.0006), 1)
    assert not {x for x in run(spark, {1: v}) if x[2] == "standstill"}


def test_null_source_few_readings_and_empty(spark):
    assert run(spark, {None: [1.0, -1.0, None, float("nan"), float("inf")], 4: [2.0], 5: []}) == {("ohlc", 1, "range"), ("ohlc", 4, "range")}
    assert run(spark, {}) == set()


def zigzag(n, seed=11, move=0.001):
    """Log steps to and fro, each of about the usual move, without drift."""
    return 100 * np.exp(np.resize([-0.5, 0.5], n) * move * np.random.default_rng(seed).uniform(0.9, 1.1, n))


def test_over_ten_usual_moves_is_a_spike(spark):
    v = zigzag(400)
    move = np.median(np.abs(np.diff(np.log(v))))
    v[100] = 100 * np.exp(11.5 * move)
    v[200] = 100 * np.exp(-11.0 * move)
    v[300] = 100 * np.exp(9.0 * move)
    assert {(i - 100_000, r) for _, i, r in run(spark, {1: v})} == {(100, "spike"), (200, "spike")}


def test_neighbouring_bad_readings_of_unlike_sizes(spark):
    v = zigzag(400)
    v[100:102] = 300, 150
    v[200:203] = 140, 500, 70
    v[300:308] = [300] + [103] * 7  # what stays seven readings is the level around the first
    want = {100, 101, 200, 201, 202, 300}
    assert {(i - 100_000, r) for _, i, r in run(spark, {1: v}) if r != "standstill"} == {(i, "spike") for i in want}


def test_t_quantile_and_limits():
    assert sp.t_quantile(0.975, np.array([10.0]))[0] == pytest.approx(2.228, abs=0.01)
    x = np.random.default_rng(0).normal(0, 1, 200)
    x[[5, 50]] = 12, -15
    assert set(np.flatnonzero(sp.gesd(x, 1.0))) >= {5, 50} and sp.gesd(x, 1.0).sum() < 5


def test_gesd_recomputes_after_each_removal():
    """Against the test by its definition, value by value."""
    rng = np.random.default_rng(3)
    for k in range(20):
        x = rng.standard_t(3, 120)
        x[:k] += 30
        left, removed, deviates = list(range(120)), [], 0
        for i in range(60):
            v = x[left]
            at = int(np.argmax(np.abs(v - v.mean())))
            if abs(v[at] - v.mean()) / v.std(ddof=1) > sp.gesd_limit(len(v)):
                deviates = i + 1
            removed.append(left.pop(at))
        assert set(np.flatnonzero(sp.gesd(x))) == set(removed[:deviates])


def test_without_deviates_there_are_no_spikes(spark, monkeypatch):
    v = zigzag(400)
    v[::9] *= 1.05  # with these left in, the mean move would be eleven times as large
    want = {("ohlc", 100_000 + i, "spike") for i in range(9, 399, 9)}
    assert run(spark, {1: v}) == want
    seen = sp.Seen(np.log(v), np.arange(400) * 3_600_000_000, slice(0, 400))
    assert sp.spikes(seen, sp.usual_of_whole(seen, 5), 10.0, 5).sum() == len(want)
    monkeypatch.setattr(sp, "gesd_bounds", lambda *_: (-np.inf, np.inf))
    assert not sp.spikes(seen, sp.usual_of_whole(seen, 5), 10.0, 5).any()


@pytest.mark.parametrize("chunk", [sp.CHUNK_ROWS, 200])
def test_what_comes_back_every_day_is_no_spike(spark, chunk):
    """One hour of each day lies thirty usual moves above the others; a reading as high at another hour is a spike."""
    x = np.log(zigzag(960))
    x[15::24] += 0.03
    x[500] += 0.03
    x[15 + 24 * 20] -= 0.03  # the hour that should be high and is not
    assert run(spark, {1: 100 * np.exp(x)}, chunk_rows=chunk) == {("ohlc", 100_500, "spike"), ("ohlc", 100_495, "spike")}


def test_readings_without_a_time_are_checked_for_range(spark):
    rows = [(1, None, 900 + i, v, 9, 9, 9) for i, v in enumerate([-1.0, 0.0, 5.0, None, float("inf"), 1e300])] * 2 + [(1, T0 + timedelta(hours=i), i, float(v), 9, 9, 9) for i, v in enumerate(series(300, 6))]
    for chunk in (sp.CHUNK_ROWS, 100):
        out = sp.implausible(spark.createDataFrame(rows, R), spark.createDataFrame([], E), chunk_rows=chunk).collect()
        assert sorted((r["tab"], r["rec_id"], r["reason"]) for r in out) == [("ohlc", 900, "range"), ("ohlc", 901, "range"), ("ohlc", 904, "range")]
