import math

from pyspark.sql import Window

from panelspark.functions.aggregates import corr


def test_correlation_of_what_does_not_vary_is_null(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 0.5), ("a", None, 9.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0), ("c", 1.0, 2.0), ("d", None, None)]
    df = spark.createDataFrame([(k, i, x, y) for i, (k, x, y) in enumerate(rows)], "k string, i int, x double, y double")
    got = {r["k"]: r["c"] for r in df.groupBy("k").agg(corr("x", "y").alias("c")).collect()}
    assert math.isclose(got["a"], -0.9819805060619659) and [got[k] for k in "bcd"] == [None] * 3
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-1, 0)
    rolled = {(r["k"], r["i"]): r["c"] for r in df.select("k", "i", corr("x", "y", w).alias("c")).collect()}
    assert math.isclose(rolled[("a", 1)], -1.0) and rolled[("a", 0)] is None and rolled[("b", 5)] is None
