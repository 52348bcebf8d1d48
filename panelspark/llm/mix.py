"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import join_dimension, one_per_key, with_single
from .encode import SPREAD_BYTES, any_long, count_tokens, encode, one_per_document
from .vocabulary import FOLDER, VOCABULARY

#: Bins of the hash over which the tokens of a source are summed up for the calibration.
BINS = 8192


def label(source: Column) -> Column:
    """A source's label: case and blanks around it do not count."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def poisson_cdf(below: int, rate: float) -> np.ndarray:
    """P(X <= k) of a Poisson distribution for every k below `below`; by logarithms, so that no rate is too large."""
    if rate <= 0:
        return np.ones(below)
    k = np.arange(below)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(k[1:], 1)))])
    return np.minimum(np.cumsum(np.exp(k * math.log(rate) - rate - log_factorial)), 1.0)


def solve(by_bin: np.ndarray, target: float, most: int) -> tuple[float, tuple[float, ...]]:
    """(rate, thresholds): the mean at which a Poisson count cut at `most` gives `target` tokens.

    by_bin: tokens by bin of the hash. The tokens with a hash from x on, summed over x = P(X <= k), k < most, are what
    the rate gives; that grows with the rate, so it is found by bisection on the binned tokens themselves rather than
    on their expectation.
    """
    total = float(by_bin.sum())
    if most <= 0 or total <= 0 or target <= 0:
        return 0.0, ()
    if target >= most * total:
        return math.inf, (0.0,) * most
    above = np.concatenate([np.cumsum(by_bin[::-1])[::-1], [0.0]])
    edges = np.linspace(0, 1, len(above))

    def given(rate: float) -> float:
        return float(np.interp(poisson_cdf(most, rate), edges, above).sum())

    lo, hi = 0.0, 1.0
    while given(hi) < target:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if given(mid) < target else (lo, mid)
    return hi, tuple(poisson_cdf(most, hi).tolist())


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / float(1 << 52)


def plan(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, target_share, max_repeat, rate, thresholds): one row a target source, such that it gets its share of all tokens.

    sizes: source, u, n_tokens of every document. The rate of a source is solved in a task of its own, from at most
    BINS sums; a document comes as often as its uniform hash u reaches one of the thresholds. Computed once, into the
    shared folder.
    """
    t = one_per_key(targets.select(label(F.col("source")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeat").cast("int"), F.lit(0)).alias("max_repeat")).filter("source IS NOT NULL"), ["source"])
    sums = cut_lineage(sizes.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")))
    wanted = with_single(t.join(sums, "source", "left"), sums.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = np.zeros(BINS)
        known = pdf[pdf["bin"].notna()]
        np.add.at(bins, known["bin"].astype(int).to_numpy(), known["n"].to_numpy(float))
        row = pdf.iloc[0]
        rate, thresholds = solve(bins, float(row["target_share"]) * float(row["total"]), int(row["max_repeat"]))
        return pd.DataFrame([{"source": row["source"], "target_share": row["target_share"], "max_repeat": row["max_repeat"], "rate": rate, "thresholds": list(thresholds)}])

    return cut_lineage(wanted.groupBy("source").applyInPandas(fit, "source string, target_share double, max_repeat int, rate double, thresholds array<double>"))


def document_sizes(docs: DataFrame, key: str, source: str, text: str, seed: int, name: str, folder: str, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """(key, source, u, n_tokens) of every document, one row a key; texts from spread_bytes on are encoded over several tasks."""
    base = docs.select(F.col(key).alias("key"), label(F.col(source)).alias("source"), uniform(F.col(key), seed).alias("u"), F.col(text).alias("text"))
    if not any_long(base, "text", spread_bytes):
        return count_tokens(base, ["key", "source", "u"], "text", name, folder)
    long = F.coalesce(F.octet_length("text") >= spread_bytes, F.lit(False))
    ids = encode(base.filter(long), "key", "text", name, folder, spread_bytes=spread_bytes)
    of_long = base.filter(long).drop("text").join(ids.select("key", F.size("ids").alias("n_tokens")), "key")
    return count_tokens(base.filter(~long), ["key", "source", "u"], "text", name, folder).unionByName(of_long)


def times(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """docs (source, u, ...) of the target sources with _times, how often each comes, where it does."""
    return join_dimension(docs, plans.select("source", "thresholds"), "source").withColumn("_times", F.size(F.filter("thresholds", lambda x: x <= F.col("u")))).drop("thresholds").filter("_times > 0")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 8, name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """The mixture: docs' columns (source as its label), copy_no from 1, order_key; partitions and rows in the order of order_key's hash.

    The mixture's size is the token count of all documents, of which each target source gets its share; a source whose
    documents do not suffice at max_repeat uses each gives all it can. Documents with a null or other source are not
    used (but count for the size); empty texts have no tokens and come as often as others. Rows with a null key are
    left out and repeated keys count once. No targets or no documents give an empty result.
    """
    docs = one_per_document(docs, key)
    plans = plan(targets, document_sizes(docs, key, source, text, seed, name, folder))
    own = docs.select(F.struct(*docs.columns).alias("_doc"), label(F.col(source)).alias("source"), uniform(F.col(key), seed).alias("u"))
    copies = times(own, plans).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    columns = [F.col("source").alias(c) if c == source else F.col("_doc")[c].alias(c) for c in docs.columns]
    placed = copies.select(*columns, "copy_no").withColumn("order_key", F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy_no")))
    return placed.repartition("order_key").sortWithinPartitions("order_key")


def shares(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 8, name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """(source, target_share, max_repeat, rate, documents, copies, most_copies, tokens, reached_share): the mixture by target source.

    reached_share: the source's tokens over the token count of all documents.
    """
    sizes = cut_lineage(document_sizes(one_per_document(docs, key), key, source, text, seed, name, folder))
    plans = plan(targets, sizes)
    used = times(sizes, plans).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("_times").alias("copies"), F.max("_times").alias("most_copies"), F.sum(F.col("_times") * F.col("n_tokens")).alias("tokens")
    )
    out = with_single(plans.join(used, "source", "left"), sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("_total")))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("documents", "copies", "most_copies", "tokens")]
    return out.select("source", "target_share", "max_repeat", "rate", *zero, (F.coalesce(F.col("tokens"), F.lit(0)) / F.greatest("_total", F.lit(1))).alias("reached_share"))
