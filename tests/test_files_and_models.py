import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import allocate, backtest, cluster, temporal
from panelspark.sources import files
from panelspark.streaming import ticks


def test_price_files(spark, tmp_path):
    rows = "\n".join(f"2024-01-{d:02d},1,1,1,{d}" for d in range(1, 21))
    (tmp_path / "good.csv").write_text("date,open,high,low,close\n" + rows + "\nbroken\n")
    (tmp_path / "short.csv").write_text("Date,Close\n2024-01-01,5\n")
    (tmp_path / "empty.csv").write_text("")
    got, bad = files.price_files(spark, str(tmp_path))
    assert {(r["algo_id"], r["n"]) for r in files.inspect(got, "algo_id", "ts").collect()} == {("good", 20)}
    assert [(r["file_name"], r["line_no"], r["reason"]) for r in bad.collect()] == [("good.csv", 22, "columns")]


def test_formats_rolls_and_top(spark):
    df = spark.createDataFrame([("a", "31/12/2020"), ("a", "13/01/2020"), ("b", "2020-12-31"), ("b", "x"), ("b", "2020-01-02"), ("c", "?")], "f string, s string")
    got = {(r["f"], r["s"]): str(r["ts"])[:10] for r in files.parse_by_majority(df, "f", "s", ["yyyy-MM-dd", "dd/MM/yyyy"]).collect()}
    assert got[("a", "13/01/2020")] == "2020-01-13" and got[("b", "2020-01-02")] == "2020-01-02" and got[("b", "x")] == got[("c", "?")] == "None"
    fut = spark.createDataFrame([("ESH4", "d", 10.0, 5), ("ESM4", "d", 11.0, 9), ("ESZ23", "d", -1.0, 99), ("ESH4-ESM4", "d", 1.0, 100), ("6EU5", "d", 1.1, 1)], "symbol string, date string, close double, volume long")
    assert {(r["root"], r["symbol"]) for r in files.front_contracts(fut, "symbol", "date", "close", "volume").collect()} == {("ES", "ESM4"), ("6E", "6EU5")}
    assert {r["symbol"] for r in files.top_by_mean(fut, "symbol", "volume", 2).collect()} == {"ESH4-ESM4", "ESZ23"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 200, 0.5), (2, 100_000, None)], "trial_id long, n long, sharpe double")
    small = files.narrowed(df)
    assert dict(small.dtypes) == {"trial_id": "tinyint", "n": "int", "sharpe": "float"}
    files.append_trials(df, str(tmp_path / "t"))
    files.append_trials(df.withColumn("trial_id", F.col("trial_id") + 2), str(tmp_path / "t"))
    assert [r["trial_id"] for r in files.best_trials(spark, str(tmp_path / "t"), "sharpe", 2).collect()] == [1, 3]
    files.write_table(df, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2


def blobs(spark, n=40):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (n, 2)) for c in ((0, 0), (4, 4), (0, 5))])
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "u": x[:, 0], "v": x[:, 1]})), x


def parts(rows, key="id"):
    out = {}
    for r in rows:
        out.setdefault(r["label"], set()).add(r[key])
    return {frozenset(s) for s in out.values()}


def test_clusters(spark, tmp_path):
    df, x = blobs(spark)
    want = {frozenset(range(i, i + 40)) for i in (0, 40, 80)}
    assert parts(cluster.kmeans(df, "id", ["u", "v"], 3).collect()) == want
    assert parts(cluster.agglomerate(df, "id", ["u", "v"], 3).collect()) == want
    far = df.unionByName(spark.createDataFrame([(999, 50.0, 50.0)], df.schema))
    assert parts(cluster.density(far, "id", ["u", "v"], 0.8, 4).collect()) == want | {frozenset([999])}
    q = cluster.quality(cluster.kmeans(df, "id", ["u", "v"], 3), ["u", "v"]).first()
    lab = np.repeat([0, 1, 2], 40)
    d2 = ((x[:, None] - x) ** 2).sum(2)
    a = np.array([d2[i][lab == lab[i]].sum() / 39 for i in range(120)])
    b = np.array([min(d2[i][lab == o].mean() for o in range(3) if o != lab[i]) for i in range(120)])
    assert q["silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=1e-9)
    mu = np.stack([x[lab == c].mean(0) for c in range(3)])
    within = sum(((x[lab == c] - mu[c]) ** 2).sum() for c in range(3))
    between = sum(40 * ((mu[c] - x.mean(0)) ** 2).sum() for c in range(3))
    assert q["calinski_harabasz"] == pytest.approx(between / 2 / (within / 117))
    assert len(cluster.principal(cluster.vectors(df, "id", ["u", "v"]), "id", ["u", "v"]).collect()) == 120


def test_hidden_markov_finds_the_calm_and_the_wild(spark):
    rng = np.random.default_rng(1)
    s = np.concatenate([np.full(150, 0.1), np.full(150, 1.0), np.full(150, 0.1)])
    df = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2020-01-01", periods=450).date, "v": s + rng.normal(0, 0.05, 450)}))
    got = cluster.hidden_markov(df, ["v"], 2).orderBy("date").toPandas()
    assert (got["state"].to_numpy() == (s > 0.5)).mean() > 0.98 and set(got["method_used"]) == {"hmm"}
    assert set(cluster.hidden_markov(df.limit(50), ["v"], 2).toPandas()["method_used"]) == {"quantiles"}


def test_optimizers():
    rng = np.random.default_rng(2)
    m = rng.normal(0.001, 0.01, (300, 5)) * np.array([1, 2, 3, 4, 5])
    cov = np.cov(m, rowvar=False)
    w = allocate.capped_minimum_variance(cov, 1.0)
    free = np.linalg.solve(cov, np.ones(5))
    assert w.sum() == pytest.approx(1) and (free < 0).any() or np.allclose(w, free / free.sum(), atol=1e-3)
    assert allocate.capped_minimum_variance(cov, 0.25).max() <= 0.25 + 1e-6
    e = allocate.equal_risk(cov)
    part = e * (cov @ e)
    assert np.allclose(part, part.mean(), rtol=1e-3) and e.sum() == pytest.approx(1)
    s = allocate.max_sharpe(m.mean(0), cov)
    assert s @ m.mean(0) / np.sqrt(s @ cov @ s) >= w @ m.mean(0) / np.sqrt(w @ cov @ w) - 1e-9


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, "b", 5), (4, None, 5), (5, "a", None)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("a", 5, 51.0), (None, 1, 7.0), ("a", None, 9.0)], "k string, t2 long, v double")
    run = lambda **how: {r["id"]: r["v"] for r in temporal.asof_join(left, right, ["k"], "t", "t2", ["v"], **how).collect()}
    assert run() == {1: 51.0, 2: None, 3: None, 4: None, 5: None}
    assert run(strict=True) == {1: 10.0, 2: None, 3: None, 4: None, 5: None}
    assert run(fallback="first") == {1: 51.0, 2: 10.0, 3: None, 4: None, 5: None}
    assert run(direction="forward") == {1: 51.0, 2: 10.0, 3: None, 4: None, 5: None}
    assert run(direction="forward", strict=True)[1] is None


def test_static_schedule_earns_the_plain_sum(spark):
    days = pd.date_range("2024-01-01", periods=6).date
    r = spark.createDataFrame(pd.DataFrame({"date": list(days) * 2, "algo_id": ["a"] * 6 + ["b"] * 6, "ret": [0.01] * 6 + [0.03] * 6}))
    w = spark.createDataFrame(pd.DataFrame({"date": [days[1], days[1]], "algo_id": ["a", "b"], "w": [0.5, 0.5]}))
    got = backtest.run(w, r).orderBy("date").collect()
    assert [str(x["date"]) for x in got] == [str(d) for d in days[2:]] and all(x["ret"] == pytest.approx(0.02) for x in got)
    assert backtest.run(w, r, same_day=True).count() == 5


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-0{d} 1{h}:00:00", float(10 * d + h)) for d in (1, 2, 5) for h in (0, 3, 1)]
    df = spark.createDataFrame(rows, "k string, t string, v double").select("k", F.col("t").cast("timestamp").alias("t"), "v")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ticks.daily_bars(s, "k", "t", "v").writeStream.format("memory").queryName("bars_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r["day"])[:10], r["open"], r["high"], r["close"]) for r in spark.sql("SELECT * FROM bars_out").collect()) == [("2024-01-01", 10.0, 13.0, 13.0), ("2024-01-02", 20.0, 23.0, 23.0)]
    r = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).select("k", (F.col("v") * 0 + 0.1).alias("r"))
    q = ticks.running_drawdown(r, "k", "r").writeStream.format("memory").queryName("dd_out").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT * FROM dd_out ORDER BY n DESC").first()
    assert last["n"] == 9 and last["equity"] == pytest.approx(1.1**9) and last["drawdown"] == 0


def test_lines_of_a_file_read_in_splits(spark, tmp_path):
    text = "".join(f"{i},{'x' * (i % 50)}\r\n" for i in range(3000)) + "last"
    (tmp_path / "a.csv").write_text(text, newline="")
    (tmp_path / "b.csv").write_text("one\n\ntwo\n", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        raw = files.text_lines(spark, str(tmp_path))
        rows = raw.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r["file_name"], r["line_no"]): r["line"] for r in rows}
    assert len(got) == len(rows) == len({r["line_id"] for r in rows})
    assert [got[("a.csv", i + 1)] for i in range(3001)] == text.split("\n") and [got[("b.csv", i)] for i in (1, 2, 3)] == ["one", "", "two"]


def test_daily_bars_of_files_and_their_floors(spark, tmp_path):
    days = [f"2024-01-{d:02d}" for d in range(1, 13)]
    (tmp_path / "good.csv").write_text("datetime,Open,high,LOW,close\n" + "".join(f"{d} 10:00,1,9,0.5,2\n{d} 09:00,4,5,3,4\n{d} 11:00,1,2,x,3\n" for d in days))
    (tmp_path / "bare.csv").write_text("date;close\n" + "".join(f"{d};7\n" for d in days))
    (tmp_path / "tiny.csv").write_text("date,close\n2024-01-01,1\n")
    (tmp_path / "few.csv").write_text("date,close\n" + "".join(f"{d},1\n" for d in days[:9]))
    (tmp_path / "oneday.csv").write_text("date,close\n" + "".join(f"2024-01-01 {h:02d}:00,1\n" for h in range(20)))
    got = {(r["algo_id"], str(r["date"])): tuple(r[c] for c in ("open", "high", "low", "close", "n")) for r in files.daily_price_files(spark, str(tmp_path)).collect()}
    assert {a for a, _ in got} == {"good", "bare"} and len(got) == 24
    assert got[("good", days[0])] == (4.0, 9.0, 0.5, 3.0, 3) and got[("bare", days[3])] == (7.0, 7.0, 7.0, 7.0, 1)
    assert {(r["algo_id"], r["bytes"] > 0) for r in files.list_files(spark, str(tmp_path)).collect()} == {(x, True) for x in ("good", "bare", "tiny", "few", "oneday")}


def test_the_last_appended_trial_counts_and_text_sinks(spark, tmp_path):
    one = spark.createDataFrame([(1, 9.0, [1]), (2, 1.0, [2])], "trial_id long, sharpe double, path array<int>")
    files.append_trials(one, str(tmp_path / "t"))
    files.append_trials(spark.createDataFrame([(1, 0.5, [3])], one.schema), str(tmp_path / "t"))
    assert [(r["trial_id"], r["sharpe"]) for r in files.best_trials(spark, str(tmp_path / "t"), "sharpe", 5).collect()] == [(2, 1.0), (1, 0.5)]
    files.write_text(one, str(tmp_path / "c"), "csv")
    files.write_text(one, str(tmp_path / "j"), "json")
    assert {(r["trial_id"], r["path"]) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("1", "[1]"), ("2", "[2]")}
    assert {(r["trial_id"], tuple(r["path"])) for r in spark.read.json(str(tmp_path / "j")).collect()} == {(1, (1,)), (2, (2,))}
    with pytest.raises(ValueError):
        files.write_text(one, str(tmp_path / "x"), "xml")


def test_merges_against_their_definitions():
    rng = np.random.default_rng(5)
    for n in (1, 2, 25, 60):
        x = rng.normal(0, 1, (n, 3))
        groups = [[i] for i in range(n)]
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        while len(groups) > max(1, n // 5):
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
            groups[i] += groups[j]
            del groups[j]
        label = cluster.cut(n, cluster.ward_merges(x), max(1, n // 5))
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == {frozenset(g) for g in groups}
    d = np.array([[0, 1, 5, 6], [1, 0, 5.5, 6.5], [5, 5.5, 0, 2], [6, 6.5, 2, 0]])
    assert [tuple(m) for m in cluster.average_merges(d)] == [(0, 1, 1.0), (2, 3, 2.0), (0, 2, 5.75)]


def test_assignment_is_that_of_taking_one_by_one(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), f"n{n}", float(rng.integers(0, 30))) for s in range(30) for n in range(25)] + [(None, "n0", 99.0), (1, None, 99.0), (1, "n1", None)]
    taken, used = {}, set()
    for s, n, _ in sorted((r for r in rows if None not in r), key=lambda r: (-r[2], r[0], r[1])):
        if s not in taken and n not in used:
            taken[s] = n
            used.add(n)
    df = spark.createDataFrame(rows, "state int, name string, score double")
    got = cluster.unique_assignment(df, "state", "name", "score").collect()
    assert {r["state"]: r["name"] for r in got} == taken and len(got) == len(taken) == 25
    assert cluster.unique_assignment(df.limit(0), "state", "name", "score").count() == 0


def test_clusters_by_correlation(spark):
    df = spark.createDataFrame([("a", "b", 0.9), ("c", "d", -0.8), ("a", "c", 0.1), ("a", "d", 0.0), ("b", "c", None), ("b", "d", 0.2)], "a string, b string, corr double")
    assert parts(cluster.correlation_clusters(df, 2).collect(), "entity") == {frozenset("ab"), frozenset("cd")}


def test_states_become_regimes(spark):
    rng = np.random.default_rng(8)
    means = {s: rng.normal(0, 1, 3) for s in range(5)}
    rows = [(s, *(float(x) for x in m + rng.normal(0, 0.1, 3))) for s, m in means.items() for _ in range(20)]
    got = {r["state"]: r["regime"] for r in cluster.states_to_regimes(spark.createDataFrame(rows, "state int, trend double, vol double, momentum double")).collect()}
    m = pd.DataFrame(rows, columns=["s", "t", "v", "m"]).groupby("s").mean()
    n = (m - m.min()) / (m.max() - m.min())
    score = {(s, r): v for s, (t, v_, mo) in zip(n.index, n.to_numpy()) for r, v in {"expansion": 0.4 * t + 0.3 * (1 - v_) + 0.3 * mo, "slowdown": 0.3 * t + 0.4 * v_ + 0.3 * (1 - mo), "recession": 0.5 * (1 - t) + 0.5 * v_, "recovery": 0.2 * (1 - t) + 0.4 * (1 - v_) + 0.4 * mo}.items()}
    want = {}
    for (s, r), _ in sorted(score.items(), key=lambda x: -x[1]):
        if s not in want and r not in want.values():
            want[s] = r
    for s in n.index:
        want.setdefault(s, max(("expansion", "slowdown", "recession", "recovery"), key=lambda r: score[(s, r)]))
    assert got == want


def test_components_counts_and_layers(spark):
    df, x = blobs(spark)
    rows = cluster.loadings(df, ["u", "v"]).collect()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    for c in (1, 2):
        mine = np.array([r["loading"] for r in rows if r["component"] == c])
        assert abs(mine @ vectors[:, -c]) == pytest.approx(1, abs=1e-9) and next(r["share"] for r in rows if r["component"] == c) == pytest.approx(values[-c] / values.sum(), abs=1e-9)
    q = {r["k"]: r for r in cluster.by_count(df, "id", ["u", "v"], range(2, 5)).collect()}
    assert max(q, key=lambda k: q[k]["silhouette"]) == 3 and q[3]["clusters"] == 3
    two = cluster.two_layers(df, "id", ["u", "v"], ["u", "v"], 3, 2, least=40).collect()
    assert len(two) == 120 and len({r["label"] for r in two}) == 6
    assert {r["layer2"] for r in cluster.two_layers(df, "id", ["u", "v"], ["u", "v"], 3, 2, least=41).collect()} == {0}
    assert cluster.two_layers(df.limit(0), "id", ["u"], ["v"], 2, 2).count() == 0


def test_budgets_of_families_to_members(spark):
    budgets = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "dead", 1.0), (1, "minus", -5.0), (2, "a", 0.0), (2, "b", None), (3, "dead", 1.0)], "date int, family string, w double")
    members = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "z"), (2, "a", "x"), (2, "b", "z"), (2, "other", "o")], "date int, family string, algo_id string")
    got = {(r["date"], r["algo_id"]): r["w"] for r in allocate.decoded(budgets, members).collect()}
    assert got == pytest.approx({(1, "x"): 1 / 3, (1, "y"): 1 / 3, (1, "z"): 1 / 3, (2, "x"): 0.5, (2, "z"): 0.5})
    back = allocate.encoded(spark.createDataFrame([(1, "x", 0.2), (1, "y", 0.1), (1, "z", 0.1)], "date int, algo_id string, w double"), members.filter("date = 1").select("algo_id", "family"))
    assert {r["family"]: r["w"] for r in back.collect()} == pytest.approx({"a": 0.75, "b": 0.25})
