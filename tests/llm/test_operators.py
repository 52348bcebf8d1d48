"""The text operators on small tables: edge cases, whole-text encoding, brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import mix, split
from panelspark.llm.encode import encode
from panelspark.llm.split import MARK, NONE, PLAIN, StrongestCut, pieces, strengths
from panelspark.llm.vocabulary import vocabulary

DOCS = "doc_id long, source string, text string, ids string, piece_no int, key long, u double, n_tokens int"
WORDS = "the allocator closed positions; drawdown fell, then rose. La cartera se desvió\n\nFinal note: sell-off 数据处理引擎在夜间运行，然后停止。".split(" ")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1, 2, 0.5, 3) for i, s, t in rows], DOCS)


def test_encode_any_rows(spark):
    v = vocabulary()
    texts = {1: "", 2: None, 3: "a", 4: prose(3000, 1), 5: "<|endoftext|>", 6: "中文" * 5000, 7: "x" * 20_000, 8: prose(10, 2)}
    rows = [(i, "s", t) for i, t in texts.items()] + [(4, "s", texts[4]), (8, "s", texts[8]), (None, "s", "lost"), (None, "s", None)]
    for how in ({}, {"spread_bytes": 500, "fragment_bytes": 100}):
        got = encode(docs(spark, rows), **how).collect()
        assert {r["doc_id"]: r["ids"] for r in got} == {i: v.encode(t or "").tolist() for i, t in texts.items()}
        assert len(got) == len(texts)
    assert encode(docs(spark, [])).count() == 0


def test_strongest_cut_against_scan():
    rng = np.random.default_rng(3)
    s = rng.integers(-1, 7, 300).astype(np.int8)
    table = StrongestCut(s, 64)
    for _ in range(500):
        lo = int(rng.integers(0, 299))
        hi = int(rng.integers(lo, min(299, lo + 150)))
        best = max(range(lo, hi + 1), key=lambda i: (s[i], i))
        assert table.best(lo, hi) == best


def test_strengths():
    text = "One. Two, three\n\nfour five_six 中。"
    data = text.encode()
    s = strengths(data)
    at = lambda part: s[data.index(part.encode()) + len(part.encode())]
    assert [at("One."), at("Two,"), at("\n\n"), at("four"), at("five_"), at("。")] == [split.SENTENCE, split.CLAUSE, split.PARAGRAPH, split.WORD, MARK, split.PARAGRAPH]
    assert at("fi") == PLAIN and s[data.index("中".encode()) + 1] == NONE


@pytest.mark.parametrize("text", [prose(4000, 5), "中文没有标点" * 900, "y" * 9000, "a_b" * 3000, "\n\n".join(prose(60, i) for i in range(30)), "🚀" * 3000, " " * 5000 + "end " * 700])
def test_pieces_cover_the_text(text):
    v, data = vocabulary(), text.encode()
    found = pieces(text, v)
    assert len(v.encode(text)) > 512 and found[0][0] == 0 and found[-1][1] == len(data)
    for (a, b, n, r), nxt in zip(found, [*found[1:], None]):
        assert n == len(v.encode(data[a:b].decode())) <= 512
        if nxt:
            assert a < nxt[0] <= b < nxt[1]
            assert nxt[3] == len(v.encode(data[nxt[0] : b].decode())) <= 64
    s = strengths(data)
    for (a, b, *_), nxt in zip(found, found[1:]):
        if s[b] <= PLAIN:
            start = max(p[1] for p in found if p[1] < b) + 1 if any(p[1] < b for p in found) else a + 1
            assert not (s[start : b + 1] > PLAIN).any()


def test_short_ones_give_nothing(spark):
    v = vocabulary()
    exact = "a " * 512
    while len(v.encode(exact)) > 512:
        exact = exact[:-1]
    rows = [(1, "s", None), (2, "s", ""), (3, "s", exact), (4, "s", exact + " b c d"), (4, "s", exact + " b c d"), (None, "s", prose(4000, 1))]
    got = split.split(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {4} and sorted(r["piece_no"] for r in got) == list(range(len(got)))
    assert split.split(docs(spark, [])).count() == 0


def corpus(n, seed=0):
    rng = random.Random(seed)
    kinds = [("big", 0.6), (" Big ", 0.1), ("mid", 0.2), ("tiny", 0.05), (None, 0.03), ("other", 0.02)]
    return [(i, rng.choices([k for k, _ in kinds], [w for _, w in kinds])[0], prose(rng.randrange(1, 60), i)) for i in range(n)]


TARGETS = [("BIG ", 0.3, 1), ("mid", 0.4, 3), ("tiny", 0.2, 4), ("absent", 0.1, 2)]


def test_mixture_reaches_its_shares(spark):
    v, rows = vocabulary(), corpus(1500)
    df, targets = docs(spark, rows), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    total = sum(len(v.encode(t)) for *_, t in rows)
    tokens = {i: len(v.encode(t)) for i, _, t in rows}
    got = mix.mix(df, targets).select("doc_id", "source", "copy_no", "order_key").collect()
    assert len({(r["doc_id"], r["copy_no"]) for r in got}) == len(got)
    most = {"big": 1, "mid": 3, "tiny": 4}
    used = dict.fromkeys(most, 0)
    for r in got:
        assert r["copy_no"] <= most[r["source"]]
        used[r["source"]] += tokens[r["doc_id"]]
    have = {s: sum(tokens[i] for i, k, _ in rows if k and k.strip().lower() == s) for s in most}
    for s, share in (("big", 0.3), ("mid", 0.4), ("tiny", 0.2)):
        assert used[s] / total == pytest.approx(min(share, most[s] * have[s] / total), abs=0.01)
    report = {r["source"]: r for r in mix.shares(df, targets).collect()}
    assert {s: report[s]["tokens"] for s in most} == used and report["absent"]["tokens"] == 0
    assert report["tiny"]["most_copies"] <= 4


def test_counts_are_poisson(spark):
    rate, thresholds = mix.solve(np.ones(mix.BINS), 1.5 * mix.BINS, 50)
    assert rate == pytest.approx(1.5, rel=0.01) and thresholds[0] == pytest.approx(np.exp(-rate), rel=1e-9)
    assert mix.solve(np.zeros(mix.BINS), 10, 3) == (0.0, ()) and mix.solve(np.ones(mix.BINS), 1e9, 2)[1] == (0.0, 0.0)


def test_mixture_of_nothing_and_repeats(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    assert mix.mix(docs(spark, []), targets).count() == 0 and mix.mix(docs(spark, corpus(20)), targets.limit(0)).count() == 0
    rows = corpus(300)
    once, twice = mix.mix(docs(spark, rows), targets), mix.mix(docs(spark, rows + rows[:100] + [(None, "big", "x")]), targets)
    key = ["doc_id", "copy_no"]
    assert once.select(key).exceptAll(twice.select(key)).count() == 0 == twice.select(key).exceptAll(once.select(key)).count()
    odd = spark.createDataFrame([("big", None, 1), (None, 0.5, 1), ("mid", 0.5, None)], "source string, target_share double, max_repeat int")
    assert mix.mix(docs(spark, rows), odd).count() == 0
    assert twice.filter(F.col("doc_id").isNull()).count() == 0


def test_boundaries_by_segments():
    rng = np.random.default_rng(4)
    s = rng.integers(-1, 7, 2000).astype(np.int8)
    b = split.Boundaries(s, 64)
    b.SEGMENT = 100
    for lo in range(0, 1900, 7):
        hi = lo + int(rng.integers(0, 90))
        assert b.best(lo, hi) == max(range(lo, hi + 1), key=lambda i: (s[i], i))


def test_rates_beyond_what_an_exponential_holds():
    rate, thresholds = mix.solve(np.ones(mix.BINS), 1500.0 * mix.BINS, 3000)
    assert rate == pytest.approx(1500, rel=1e-3) and len(thresholds) == 3000
    u = (np.arange(mix.BINS) + 0.5) / mix.BINS
    assert np.searchsorted(thresholds, u, side="right").mean() == pytest.approx(1500, rel=1e-3)


def test_many_sources_and_clashing_names(spark):
    """Two thousand sources, none collected; columns named like the operator's own."""
    v = vocabulary()
    rows = [(i, f"s{i % 2000}", prose(5 + i % 7, i)) for i in range(6000)]
    df = docs(spark, rows).withColumn("_times", F.lit(1)).withColumn("thresholds", F.lit("x")).withColumn("_doc", F.lit("y"))
    targets = spark.createDataFrame([(f"S{i}", 1 / 2000, 3) for i in range(2000)], "source string, target_share double, max_repeat int")
    got = mix.mix(df, targets).select("doc_id", "copy_no", "_times", "u").collect()
    assert {r["_times"] for r in got} == {1} and {r["u"] for r in got} == {0.5}
    total = sum(len(v.encode(t)) for *_, t in rows)
    used = sum(len(v.encode(rows[r["doc_id"]][2])) for r in got)
    assert len({rows[r["doc_id"]][1] for r in got}) > 1900 and used / total == pytest.approx(1, abs=0.35)


def test_long_texts_are_spread(spark):
    rows = [(1, "big", prose(3000, 1)), (2, "big", "中文没有标点" * 900), (3, "mid", prose(40, 2)), (4, "mid", None), (5, "big", " " * 4000 + "end"), (3, "mid", prose(40, 2))]
    df = docs(spark, rows)
    one = {(r["doc_id"], r["piece_no"]): (r["n_tokens"], r["repeated"], r["text"]) for r in split.split(df).collect()}
    two = {(r["doc_id"], r["piece_no"]): (r["n_tokens"], r["repeated"], r["text"]) for r in split.split(df, spread_bytes=2000).collect()}
    assert one == two and {d for d, _ in one} == {1, 2, 5}
    v = vocabulary()
    unique = df.dropDuplicates(["doc_id"])
    sizes = {r["key"]: r["n_tokens"] for r in mix.document_sizes(unique, "doc_id", "source", "text", 8, "byte_bpe_50k", "/opt/tokenizers", spread_bytes=2000).collect()}
    assert sizes == {i: len(v.encode(t or "")) for i, _, t in rows}
