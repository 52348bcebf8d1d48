"""Queries on pairs, clusters and families that leave nothing out, against brute force beside their SQL."""

import os
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel as px
from panelspark.plans import registry
from panelspark.plans.base import families, nation_panel, panel, trades
from panelspark.sources.tables import table


def test_cluster_quality_of_whole_vectors(spark, small):
    p = table(spark, small, "embeddings").select("label", "embedding").toPandas()
    x, c = np.stack(p["embedding"]).astype(float), p["label"].to_numpy()
    labels = np.unique(c)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = c == c[i]
        a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][c == o].mean() for o in labels if o != c[i])
        s.append((b - a) / max(a, b))
    mu = np.stack([x[c == o].mean(0) for o in labels])
    within = [((x[c == o] - m) ** 2).sum() for o, m in zip(labels, mu)]
    between = sum((c == o).sum() * ((m - x.mean(0)) ** 2).sum() for o, m in zip(labels, mu))
    r = [np.sqrt(w / (c == o).sum()) for o, w in zip(labels, within)]
    k = range(len(labels))
    db = np.mean([max((r[i] + r[j]) / np.linalg.norm(mu[i] - mu[j]) for j in k if j != i) for i in k])
    got = registry.QUERIES["cluster_quality"](spark, small).collect()
    assert len(got) == 1 and (got[0]["n"], got[0]["k"]) == (len(x), len(labels))
    assert got[0]["silhouette"] == pytest.approx(np.mean(s), abs=1e-4)
    assert got[0]["calinski_harabasz"] == pytest.approx(between / (len(labels) - 1) / (sum(within) / (len(x) - len(labels))), abs=1e-4)
    assert got[0]["davies_bouldin"] == pytest.approx(db, abs=1e-4)


@pytest.fixture(scope="module")
def larger():
    """Tables with enough common days for pairs."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no table directory")
    return d


@pytest.fixture(scope="module")
def wide(spark, larger):
    return nation_panel(spark, larger).toPandas().dropna(subset=["ret"]).pivot(index="date", columns="algo_id", values="ret").astype(float)


def rows(spark, larger, name):
    return registry.QUERIES[name](spark, larger).toPandas()


def test_pairs_of_all_nations(spark, larger, wide):
    both = {(a, b): wide[[a, b]].dropna() for a, b in combinations(sorted(wide.columns), 2)}
    want = {k: v.corr().iloc[0, 1] for k, v in both.items() if len(v) >= 30}
    assert wide.shape[1] > 15
    got = rows(spark, larger, "corr_matrix_pairs").set_index(["a", "b"])["corr"].to_dict()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-6, nan_ok=True) for k, v in want.items())
    c = np.array([*want.values()])
    s = rows(spark, larger, "corr_statistics").iloc[0]
    assert s["n"] == len(want) and s["mean"] == pytest.approx(np.nanmean(c), abs=1e-7)
    assert rows(spark, larger, "corr_histogram")["n"].sum() == len(c)
    assert len(rows(spark, larger, "low_corr_pairs")) == (np.abs(c) < 0.02).sum()
    assert rows(spark, larger, "corr_graph_nodes")["degree"].sum() == 2 * (np.abs(c) > 0.03).sum()
    assert rows(spark, larger, "top_pairs")["corr"].agg(["min", "max"]).tolist() == pytest.approx([c.min(), c.max()], abs=2e-6)
    assert set(rows(spark, larger, "best_diversifiers")["a"]) == {x for k in want for x in k}
    best = sorted(want, key=lambda k: (-round(want[k], 9), k))[:20]
    assert set(map(tuple, rows(spark, larger, "cointegration")[["a", "b"]].to_numpy())) <= set(best)
    cov = rows(spark, larger, "cov_matrix_pairs").set_index(["a", "b"])["cov"].to_dict()
    some = {k: v.cov().iloc[0, 1] for k, v in both.items() if len(v) > 1}
    assert cov.keys() == some.keys() and all(cov[k] == pytest.approx(v, abs=2e-6) for k, v in some.items())
    assert rows(spark, larger, "diversification_ratio")["n"].iloc[0] == len({x for k in some for x in k})
    early = {d: str(d) < "1998" for d in wide.index}
    parts = [wide[[early[d] == e for d in wide.index]] for e in (True, False)]
    assert len(rows(spark, larger, "corr_by_regime")) == sum(len(w[[a, b]].dropna()) >= 30 for w in parts for a, b in both)


def test_rolling_measures_of_all_nations(spark, larger, wide):
    got = rows(spark, larger, "mean_rolling_corr").set_index("date")
    for day in (wide.index[41], wide.index[len(wide) // 2], wide.index[-1]):
        i = wide.index.get_loc(day)
        w = wide.iloc[i - 41 : i + 1]
        r = [v.corr().iloc[0, 1] for a, b in combinations(w.columns, 2) if len(v := w[[a, b]].dropna()) >= 5]
        if str(day) in got.index:
            assert (got.at[str(day), "pairs"], got.at[str(day), "mean_corr"]) == (len(r), pytest.approx(np.mean(r), abs=2e-6))
        else:
            assert not r
    share = rows(spark, larger, "rolling_pca_share").set_index("date")["share"]
    full = px.densify(nation_panel(spark, larger), "algo_id", "ret", F.lit(0.0)).toPandas().pivot(index="date", columns="algo_id", values="ret").astype(float)
    day = sorted(share.index)[len(share) // 2]
    i = full.index.get_loc(next(d for d in full.index if str(d) == day))
    w = full.iloc[i - 42 : i].dropna(axis=1).to_numpy()
    assert w.shape[1] > 10
    e = np.linalg.eigvalsh(np.corrcoef(w[:, w.std(0) > 1e-12], rowvar=False))
    assert share.max() <= 1 and len(share) > 0
    assert share[day] == pytest.approx(e[-1] / e.sum(), abs=2e-6)


def test_every_family_is_there(spark, larger):
    fam = families(spark, larger).toPandas().set_index("algo_id")["family"]
    p = panel(spark, larger).select(F.col("date").cast("string").alias("date"), "algo_id", "ret").toPandas()
    p["family"] = p["algo_id"].map(fam).fillna("-")
    want = p.groupby(["date", "family"])["ret"].mean()
    got = rows(spark, larger, "observation_matrix")
    got = got.assign(family=got["family"].fillna("-")).set_index(["date", "family"])["ret"]
    assert len({f for _, f in got.index} - {"-"}) > 3 and got.index.is_unique
    assert got.sort_index().index.tolist() == want.sort_index().index.tolist()
    np.testing.assert_allclose(got.sort_index().to_numpy(float), want.sort_index().to_numpy(float), atol=1e-9)
    t = trades(spark, larger).filter("date_open IS NOT NULL").select(F.date_format("date_open", "yyyy-MM-01").alias("month"), "algo_id", "volume").toPandas()
    t["family"] = t["algo_id"].map(fam).fillna("unmapped")
    want = t.groupby(["month", "family"])["volume"].sum().sort_index()
    got = rows(spark, larger, "family_month_crosstab").set_index(["month", "family"])["volume"].sort_index()
    assert got.index.tolist() == want.index.tolist()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-5)
