"""Salted joins and positions against plain ones."""

import pytest
from pyspark.sql import functions as F

from passagelink.operators.spread import hot_keys, numbered, running, spread_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("hot", 1), ("cold", 1), ("alone", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c"), ("other", "o"), (None, "n")], "k string, y string")
    hot = hot_keys(left.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n"), "k", "n")
    assert rows(spread_join(left, right, "k", hot, F.xxhash64("x"), how)) == rows(left.join(right, "k", how))
    assert rows(spread_join(left, right, "k", hot.limit(0), F.xxhash64("x"), how)) == rows(left.join(right, "k", how))


def test_hot_keys_are_few(spark):
    counts = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 0, 100_000).otherwise(1).alias("n"))
    assert hot_keys(counts, "k", "n").count() == 1 and hot_keys(counts.limit(0), "k", "n").count() == 0


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("extra").alias("position_"))
    assert [(r.v, r.position) for r in numbered(df, "v").orderBy("position").collect()] == [(i, i) for i in range(1000)]
    assert [r.v for r in numbered(df, F.desc("v"), name="p").orderBy("p").limit(3).collect()] == [999, 998, 997]
    assert numbered(df.limit(0), "v").count() == 0


def test_running(spark):
    data = [(k % 3 if k % 4 else None, k * 7919 % 200, k % 11) for k in range(200)]
    df = spark.createDataFrame(data, "g int, v int, w int")
    want, low = {}, {}
    for g in {g for g, _, _ in data}:
        n, m = 0, 99
        for v, w in sorted((v, w) for h, v, w in data if h == g):
            n, m = n + w, min(m, w)
            want[g, v], low[g, v] = n, m
    assert {(r.g, r.v): r.s for r in running(df, ["g"], ["v"], "w", "s").collect()} == want
    assert {(r.g, r.v): r.s for r in running(df, ["g"], ["v"], "w", "s", "min").collect()} == low
    assert [r.s for r in running(df.filter("v < 3"), [], [F.desc("v")], "v", "s").orderBy("v").collect()] == [3, 3, 2]
    assert running(df.limit(0), ["g"], ["v"], "w", "s").count() == 0
