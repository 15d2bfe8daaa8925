"""Running totals and quantiles by ranges against plain versions, with one key holding all rows, nulls, ties and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathfold.operators import scan


def table(spark, n, keys, spread, seed=0):
    r = random.Random(seed)
    rows = [(r.choice(keys), r.choice([None, *range(spread)]), r.randrange(-50, 50), f"t{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, o int, v long, row string")


@pytest.mark.parametrize("keys, spread", [(["a"], 10_000), (["a", "b", None], 10_000), ([f"k{i}" for i in range(60)], 10_000)])
def test_running_totals(spark, keys, spread):
    rows, df = table(spark, 900, keys, spread)
    tie = F.col("row")
    got = scan.running(df, ["k"], [F.col("o"), tie], {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "x": ("xor", F.col("v")), "m": ("max", F.col("v"))}, parts=7)
    want, state = {}, {}
    for k, o, v, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[3])):
        n, s, x, m = state.get(k, (0, 0, 0, -1000))
        state[k] = (n + 1, s + v, x ^ v, max(m, v))
        want[t] = state[k]
    assert {r.row: (r.n, r.s, r.x, r.m) for r in got.collect()} == want


def test_equal_rows_are_dealt_over_ranges(spark):
    df = spark.range(0, 4000, 1, 8).select(F.lit("a").alias("k"), F.lit(1).alias("o"), F.lit(2).alias("v"))
    got = scan.running(df, ["k"], [F.col("o")], {"n": ("sum", F.lit(1))}, parts=8)
    assert sorted(r.n for r in got.collect()) == list(range(1, 4001))
    sizes = [r["count"] for r in scan.dealt(df, ["k", "o"], 8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * np.median(sizes)


def test_running_without_rows_or_keys(spark):
    df = spark.createDataFrame([], "k string, o int, v long")
    assert scan.running(df, ["k"], [F.col("o")], {"s": ("sum", F.col("v"))}).collect() == []
    one = spark.createDataFrame([(3, 1), (1, None), (2, 5)], "o int, v long")
    assert [(r.o, r.s) for r in scan.running(one, [], [F.col("o")], {"s": ("sum", F.col("v"))}, parts=3).orderBy("o").collect()] == [(1, None), (2, 5), (3, 6)]


@pytest.mark.parametrize("keys, values", [(["a"], 10**9), (["a"], 3), (["a", None, "c", "d"], 10**9), ([f"k{i}" for i in range(80)], 40)])
def test_quantiles(spark, keys, values):
    r = random.Random(len(keys) + values)
    rows = [(r.choice(keys), r.choice([None] + [r.random() * values // 1 for _ in range(9)])) for _ in range(1500)]
    points = (0.0, 0.01, 0.5, 0.95, 1.0)
    got = {x.k: x.q for x in scan.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points, parts=6).collect()}
    for k in {k for k, v in rows if v is not None}:
        assert got[k] == pytest.approx(np.quantile([v for a, v in rows if a == k and v is not None], points).tolist(), abs=1e-6)
    assert len(got) == len({k for k, v in rows if v is not None})


def test_quantiles_count_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 9.0, 0), ("b", None, 4)], "k string, v double, n int")
    assert [tuple(x) for x in scan.quantiles(df, ["k"], "v", (0.5, 1.0), counted="n").collect()] == [("a", [1.0, 5.0])]
    assert scan.quantiles(df.where("false"), ["k"], "v", (0.5,)).collect() == []
    assert [x.q for x in scan.quantiles(df.where("n > 0"), [], "v", (1.0,)).collect()] == [[5.0]]
