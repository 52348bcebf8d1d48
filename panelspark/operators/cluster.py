"""Clustering of feature rows, its quality, hidden Markov regimes.

Fits that need all rows of a small table (one row per entity, bounded by `top` where stated) run in one grouped map;
k-means, mixtures and PCA use Spark's own distributed ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_single


def vectors(df: DataFrame, key: str, features: list[str], robust: bool = True) -> DataFrame:
    """(key, features...) with nulls replaced by the median and scaled: by median and quartile distance, else mean and deviation."""
    x = df.select(key, *(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in features))
    stats = []
    for c in features:
        stats += [F.expr(f"percentile({c}, 0.5)").alias(f"{c}_m"), F.expr(f"percentile({c}, 0.75) - percentile({c}, 0.25)").alias(f"{c}_q"), F.avg(c).alias(f"{c}_a"), F.stddev_pop(c).alias(f"{c}_s")]
    s = x.agg(*stats)
    j = with_single(x, s)
    out = []
    for c in features:
        mid, width = (f"{c}_m", f"{c}_q") if robust else (f"{c}_a", f"{c}_s")
        v = F.coalesce(c, f"{c}_m")
        out.append(F.coalesce((v - F.col(mid)) / F.when(F.col(width) > 0, F.col(width)), F.lit(0.0)).alias(c))
    return j.select(key, *out)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df)


def kmeans(df: DataFrame, key: str, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """(key, features..., label). With fewer distinct rows than k there are as many clusters as rows; an empty table stays empty."""
    k = df.select(*features).distinct().limit(k).count()
    if k < 2:
        return df.select(key, *features).withColumn("label", F.lit(0))
    a = _assembled(df, features)
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="label").fit(a).transform(a).drop("_x")


def mixture(df: DataFrame, key: str, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """(key, features..., label) of a Gaussian mixture; with fewer distinct rows than k as kmeans."""
    k = df.select(*features).distinct().limit(k).count()
    if k < 2:
        return df.select(key, *features).withColumn("label", F.lit(0))
    a = _assembled(df, features)
    return GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="label", probabilityCol="_p").fit(a).transform(a).drop("_x", "_p")


def principal(df: DataFrame, key: str, features: list[str], k: int = 2) -> DataFrame:
    """(key, pc1 ... pck) of the standardised features."""
    a = _assembled(df, features)
    s = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(a).transform(a)
    out = PCA(k=k, inputCol="_z", outputCol="_c").fit(s).transform(s)
    from pyspark.ml.functions import vector_to_array

    return out.select(key, *(vector_to_array("_c")[i].alias(f"pc{i + 1}") for i in range(k)))


def loadings(df: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """(component, feature, loading, share): the directions of the first k components of the standardised features and their shares of the variance."""
    a = _assembled(df, features)
    s = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(a).transform(a)
    fitted = PCA(k=k, inputCol="_z", outputCol="_c").fit(s)
    directions, share = fitted.pc.toArray(), fitted.explainedVariance.toArray()
    rows = [(i + 1, f, float(directions[j, i]), float(share[i])) for i in range(k) for j, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double, share double")


def by_count(df: DataFrame, key: str, features: list[str], counts: range = range(2, 11)) -> DataFrame:
    """(k, clusters, silhouette, calinski_harabasz, davies_bouldin) of k-means for each number of clusters; clusters: those found."""
    from ..session import cut_lineage

    base = cut_lineage(df.select(key, *features))
    out = [quality(kmeans(base, key, features, k), features).select(F.lit(k).alias("k"), F.col("k").alias("clusters"), "silhouette", "calinski_harabasz", "davies_bouldin") for k in counts]
    return reduce(lambda a, b: a.unionByName(b), out)


def two_layers(df: DataFrame, key: str, first: list[str], second: list[str], k1: int, k2: int, least: int = 50, seed: int = 42) -> DataFrame:
    """(key, layer1, layer2, label): k-means on the first features, then on the second ones within each cluster of `least` rows; label joins both.

    Smaller clusters have layer2 0. The second layer is one fit per cluster of the first, of which there are k1.
    """
    from ..session import cut_lineage

    one = cut_lineage(kmeans(df.select(key, *first), key, first, k1, seed).select(key, F.col("label").alias("layer1")).join(df.select(key, *[c for c in second]), key))
    sizes = {r["layer1"]: r["n"] for r in one.groupBy("layer1").agg(F.count(F.lit(1)).alias("n")).collect()}  # k1 rows
    parts = []
    for c, n in sorted(sizes.items()):
        members = one.filter(F.col("layer1") == c)
        inner = kmeans(members.select(key, *second), key, second, k2, seed).select(key, F.col("label").alias("layer2")) if n >= least else members.select(key, F.lit(0).alias("layer2"))
        parts.append(inner.withColumn("layer1", F.lit(c)))
    if not parts:
        return df.select(key, F.lit(0).alias("layer1"), F.lit(0).alias("layer2"), F.lit("").alias("label")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), parts).select(key, "layer1", "layer2", F.concat_ws("_", "layer1", "layer2").alias("label"))


def states_to_regimes(states: DataFrame) -> DataFrame:
    """(state, regime) of a labelled series (state, trend, vol, momentum): the means of each state, scaled between the states, scored for four regimes.

    The best scores are given first, each state and regime once; states left over take their own best regime.
    """
    g = states.groupBy("state").agg(*(F.avg(c).alias(c) for c in ("trend", "vol", "momentum")))
    ends = g.agg(*(f(c).alias(f"{n}_{c}") for c in ("trend", "vol", "momentum") for n, f in (("lo", F.min), ("hi", F.max))))
    x = with_single(g, ends)
    t, v, m = (F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.5) for c in ("trend", "vol", "momentum"))
    # How trend, volatility and momentum weigh in each regime.
    scores = {
        "expansion": 0.4 * t + 0.3 * (1 - v) + 0.3 * m, "slowdown": 0.3 * t + 0.4 * v + 0.3 * (1 - m),
        "recession": 0.5 * (1 - t) + 0.5 * v, "recovery": 0.2 * (1 - t) + 0.4 * (1 - v) + 0.4 * m,
    }
    each = x.select("state", F.explode(F.array(*(F.struct(F.lit(r).alias("regime"), s.alias("score")) for r, s in scores.items()))).alias("e")).select("state", "e.*")
    taken = unique_assignment(each, "state", "regime", "score")
    best = each.groupBy("state").agg(F.max_by("regime", F.struct("score", "regime")).alias("best"))
    return best.join(taken, "state", "left").select("state", F.coalesce("regime", "best").alias("regime"))


def quality(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(n, k, calinski_harabasz, davies_bouldin, silhouette): from cluster sums; the silhouette by squared distances, in one pass each.

    The sum of squared distances from a row to all rows of a cluster follows from the cluster's size, sum and sum of
    squares, so no pair of rows is formed; only rows x clusters are.
    """
    row = F.array(*features)
    sq = F.aggregate(row, F.lit(0.0), lambda a, v: a + v * v)
    x = df.select(F.col(label).alias("c"), row.alias("x"), sq.alias("sq")).withColumn("id", F.monotonically_increasing_id())
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(len(features))]
    g = x.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("sq").alias("q"), *sums)
    g = g.select(F.col("c").alias("o"), "n", "q", F.array(*(f"s{i}" for i in range(len(features)))).alias("s"))
    dot = F.aggregate(F.zip_with("x", "s", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    clusters = g.agg(F.collect_list(F.struct("o", "n", "q", "s")).alias("g"))  # one element a cluster
    per = with_single(x, clusters).withColumn("g", F.explode("g")).select("c", "x", "sq", "id", "g.*").withColumn("d", F.col("sq") * F.col("n") - 2 * dot + F.col("q"))
    own = F.col("o") == F.col("c")
    mean = F.when(own, F.col("d") / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(F.col("d") / F.col("n"))
    ab = per.withColumn("m", mean).groupBy("id").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    big = F.greatest("a", "b")
    sil = ab.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(big > 0, big))).alias("silhouette"))
    centred = g.withColumn("w", F.col("q") - F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v) / F.col("n"))
    tot = centred.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("within"), F.sum("q").alias("q"), *(F.sum(F.col("s")[i]).alias(f"t{i}") for i in range(len(features))))
    mean_sq = sum((F.col(f"t{i}") * F.col(f"t{i}") for i in range(len(features))), F.lit(0.0)) / F.col("n")
    between = F.col("q") - mean_sq - F.col("within")
    ch = tot.select("n", "k", (between / (F.col("k") - 1) / (F.when(F.col("within") > 0, F.col("within")) / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    scatter = centred.select("o", F.transform("s", lambda v: v / F.col("n")).alias("mu"), F.sqrt(F.greatest(F.col("w"), F.lit(0.0)) / F.col("n")).alias("r"))
    a, b = scatter.alias("a"), scatter.alias("b")
    dist = F.sqrt(F.aggregate(F.zip_with("a.mu", "b.mu", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda acc, v: acc + v))
    pair = a.join(b, F.col("a.o") != F.col("b.o")).select(F.col("a.o").alias("o"), ((F.col("a.r") + F.col("b.r")) / F.when(dist > 0, dist)).alias("v"))  # clusters, not rows
    db = pair.groupBy("o").agg(F.max("v").alias("v")).agg(F.avg("v").alias("davies_bouldin"))
    return with_single(with_single(ch, db), sil)


def density(df: DataFrame, key: str, features: list[str], eps: float, least: int, cell: float | None = None) -> DataFrame:
    """(key, label) of DBSCAN as text, noise -1: rows meet only within neighbouring cells of the first two features; components by label passing.

    A label is the least key of a component's core rows. Passing runs until no label changes; each round is cut
    to the shared folder.
    """
    from ..session import cut_lineage

    width = cell or eps
    x = df.select(F.col(key).alias("k"), F.array(*features).alias("x")).withColumn("cx", F.floor(F.col("x")[0] / width)).withColumn("cy", F.floor(F.col("x")[min(1, len(features) - 1)] / width))
    reach = int(np.ceil(eps / width))
    near = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    spread = x.select("k", "x", F.explode(near).alias("c")).select(F.col("k").alias("k1"), F.col("x").alias("x1"), "c.cx", "c.cy")
    d2 = F.aggregate(F.zip_with("x", "x1", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda a, v: a + v)
    links = cut_lineage(spread.join(x, ["cx", "cy"]).filter(d2 <= eps * eps).select(F.col("k1").alias("a"), F.col("k").alias("b")))
    core = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("k"))
    inner = cut_lineage(links.join(core.withColumnRenamed("k", "a"), "a", "left_semi").join(core.withColumnRenamed("k", "b"), "b", "left_semi"))
    labels = cut_lineage(core.withColumn("l", F.col("k")))
    while True:
        passed = inner.join(labels.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("l").alias("l2"))
        new = cut_lineage(labels.join(passed, "k", "left").select("k", F.least("l", F.coalesce("l2", "l")).alias("l"), (F.coalesce("l2", "l") < F.col("l")).alias("moved")))
        done = not new.filter("moved").limit(1).count()
        labels = new.drop("moved")
        if done:
            break
    border = links.join(labels.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("l").alias("l"))
    out = x.select("k").join(labels.withColumnRenamed("l", "l1"), "k", "left").join(border, "k", "left")
    return out.select(F.col("k").alias(key), F.coalesce(F.coalesce("l1", "l").cast("string"), F.lit("-1")).alias("label"))


def ward_merges(x: np.ndarray) -> np.ndarray:
    """(i, j, height) of the n - 1 merges of Ward's method in order of height; i and j are rows that stand for their clusters.

    By chains of nearest neighbours on the centroids: as much memory as the rows themselves, no matrix of distances.
    """
    n = len(x)
    centre, size, alive = x.astype(float).copy(), np.ones(n), np.ones(n, bool)
    out, chain = [], []
    while len(out) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        a = chain[-1]
        d = ((centre - centre[a]) ** 2).sum(1) * (size * size[a] / (size + size[a]))
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            i, j = min(a, b), max(a, b)
            out.append((i, j, 2 * d[b]))
            centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
            size[i] += size[j]
            alive[j] = False
            del chain[-2:]
        else:
            chain.append(b)
    return np.array(sorted(out, key=lambda m: m[2])).reshape(-1, 3)


def average_merges(d: np.ndarray) -> np.ndarray:
    """(i, j, height) of the merges by average linkage of a matrix of distances, in order of height."""
    d, n = d.astype(float).copy(), len(d)
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(n), []
    for _ in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        out.append((i, j, d[i, j]))
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        new[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
    return np.array(out).reshape(-1, 3)


def cut(n: int, merges: np.ndarray, k: int) -> np.ndarray:
    """Labels from 0, by first row, of the k clusters that the lowest merges leave."""
    member = np.arange(n)

    def root(i: int) -> int:
        while member[i] != i:
            member[i] = member[member[i]]
            i = member[i]
        return i

    for i, j, _ in merges[: max(0, n - k)]:
        a, b = root(int(i)), root(int(j))
        member[max(a, b)] = min(a, b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1].astype("int32")


def agglomerate(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """(key, label) of Ward's method: one task that holds the rows' features (time grows with the square of the rows)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = pdf[features].to_numpy(float)
        return pd.DataFrame({key: pdf[key].to_numpy(), "label": cut(len(x), ward_merges(x), k)})

    kind = dict(df.dtypes)[key]
    return df.select(key, *features).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda p: fit(p), f"{key} {kind}, label int")


def correlation_clusters(pairs: DataFrame, k: int) -> DataFrame:
    """(entity, label) by average linkage on 1 - |corr| of (a, b, corr); pairs without a correlation are 1 apart. One task with the matrix of the pairs."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
        i, j = np.searchsorted(names, pdf["a"]), np.searchsorted(names, pdf["b"])
        d = np.ones((len(names), len(names)))
        d[i, j] = d[j, i] = 1 - np.abs(np.nan_to_num(pdf["corr"].to_numpy(float)))
        return pd.DataFrame({"entity": names, "label": cut(len(names), average_merges(d), k)})

    return pairs.select("a", "b", "corr").withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda p: fit(p), "entity string, label int")


def _forward_backward(x: np.ndarray, mu: np.ndarray, var: np.ndarray, trans: np.ndarray, start: np.ndarray):
    like = -0.5 * (((x[:, None, :] - mu) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1))
    top = like.max(1, keepdims=True)
    b = np.exp(like - top)
    n, k = b.shape
    alpha, scale = np.empty((n, k)), np.empty(n)
    a = start * b[0]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ trans) * b[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    return alpha, beta, b, scale, like, float(np.log(scale).sum() + top.sum())


def hidden_markov(series: DataFrame, features: list[str], states: int = 4, rounds: int = 50, seed: int = 42, least_rows: int = 100) -> DataFrame:
    """(date, state, method_used) of one series: Baum-Welch with diagonal Gaussians, then the most likely path.

    States are numbered by the mean of the first feature. With fewer than `least_rows` complete rows the states are
    quantile groups of the first feature instead, and method_used says so.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna()
        x = pdf[features].to_numpy(float)
        n = len(x)
        if n < least_rows:
            rank = pd.Series(x[:, 0] if n else []).rank(method="first")
            return pd.DataFrame({"date": pdf["date"], "state": ((rank - 1) * states // max(n, 1)).astype("int32").to_numpy(), "method_used": "quantiles"})
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        rng = np.random.default_rng(seed)
        mu = np.quantile(x, (np.arange(states) + 0.5) / states, axis=0) + rng.normal(0, 0.01, (states, x.shape[1]))
        var, trans, start = np.ones((states, x.shape[1])), np.full((states, states), 0.1 / max(states - 1, 1)), np.full(states, 1 / states)
        np.fill_diagonal(trans, 0.9)
        last = -np.inf
        for _ in range(rounds):
            alpha, beta, b, scale, _, ll = _forward_backward(x, mu, var, trans, start)
            g = alpha * beta
            g /= g.sum(1, keepdims=True)
            xi = (alpha[:-1, :, None] * trans[None] * (b[1:] * beta[1:])[:, None, :] / scale[1:, None, None]).sum(0)
            trans = (xi + 1e-6) / (xi + 1e-6).sum(1, keepdims=True)
            start = g[0] / g[0].sum()
            w = np.maximum(g.sum(0), 1e-9)[:, None]
            mu = g.T @ x / w
            var = np.maximum(np.stack([(g[:, [i]] * (x - mu[i]) ** 2).sum(0) for i in range(states)]) / w, 1e-4)
            if abs(ll - last) < 1e-4 * abs(ll):
                break
            last = ll
        like = _forward_backward(x, mu, var, trans, start)[4]
        lt = np.log(np.maximum(trans, 1e-300))
        score, back = np.log(np.maximum(start, 1e-300)) + like[0], np.zeros((n, states), int)
        for t in range(1, n):
            s = score[:, None] + lt
            back[t], score = s.argmax(0), s.max(0) + like[t]
        path = np.empty(n, int)
        path[-1] = score.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        order = np.argsort(np.argsort(mu[:, 0]))
        return pd.DataFrame({"date": pdf["date"], "state": order[path].astype("int32"), "method_used": "hmm"})

    return series.select("date", *features).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(lambda p: fit(p.drop(columns="_g")), "date date, state int, method_used string")


def weekly_clusters(periods: DataFrame, features: list[str], k: int = 3, least: int = 6, seed: int = 42, rounds: int = 25) -> DataFrame:
    """periods (week_end, algo_id, features...) -> (week_end, algo_id, label): k-means of each week on its own, weeks in parallel.

    Labels are numbered by the centre's first feature. Weeks with fewer than `least` rows: insufficient_data.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("algo_id").dropna()
        out = pdf[["week_end", "algo_id"]].copy()
        if len(pdf) < least:
            return out.assign(label="insufficient_data")
        x = pdf[features].to_numpy(float)
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        rng = np.random.default_rng(seed)
        centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            label = ((x[:, None] - centre) ** 2).sum(2).argmin(1)
            new = np.stack([x[label == i].mean(0) if (label == i).any() else centre[i] for i in range(len(centre))])
            if np.allclose(new, centre):
                break
            centre = new
        order = np.argsort(np.argsort(centre[:, 0]))
        return out.assign(label=[f"c{order[i]}" for i in label])

    return periods.select("week_end", "algo_id", *features).groupBy("week_end").applyInPandas(fit, "week_end date, algo_id string, label string")


def unique_assignment(scores: DataFrame, state: str, name: str, score: str) -> DataFrame:
    """(state, name): greatest scores first, each state and each name at most once, ties by state and name.

    Rounds: every score that is the best left of both its state and its name is taken, and both are done with; that
    gives what taking them one by one gives, in far fewer steps. Rows with a null count for nothing.
    """
    from ..session import cut_lineage

    left = cut_lineage(scores.select(state, name, F.col(score).alias("_s")).dropna())
    taken = left.limit(0)
    order = [F.col("_s").desc(), F.col(state), F.col(name)]
    while left.limit(1).count():
        first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(*order)) == 1
        new = cut_lineage(left.withColumn("_a", first(state)).withColumn("_b", first(name)).filter("_a AND _b").select(state, name, "_s"))
        taken = taken.unionByName(new)
        left = cut_lineage(left.join(new.select(state), state, "left_anti").join(new.select(name), name, "left_anti").select(state, name, "_s"))
    return taken.select(state, name)
