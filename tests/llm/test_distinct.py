"""Bit matrices: accuracy, union, bounds, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.distinct import RANKS, cube, estimate, fit, merge, sketch


@pytest.mark.parametrize("n", [1, 5, 100, 3000, 200_000])
def test_error_is_within_its_bound(spark, n):
    df = spark.range(n).select((F.col("id") % 7).alias("g"), F.concat(F.lit("customer-"), F.col("id").cast("string")).alias("i"))
    r = estimate(sketch(df.union(df), [], "i"), []).first()
    assert abs(r["n_distinct"] - n) <= max(1, 3.5 * r["std_error"]) and r["lower"] <= r["n_distinct"] <= r["upper"] + 1
    if n >= 3000:
        assert r["std_error"] / n < 0.025


def test_union_of_days_is_the_sketch_of_all(spark):
    df = spark.range(5000).select((F.col("id") % 5).alias("day"), (F.col("id") % 1200).cast("string").alias("i"))
    one = {tuple(r) for r in sketch(df, [], "i").collect()}
    assert {tuple(r) for r in merge(sketch(df, ["day"], "i"), []).collect()} == one


def test_combinations(spark):
    rows = [("x", "p", "1"), ("x", "q", "1"), ("x", "q", "2"), (None, "q", "3"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, i string")
    out = estimate(cube(sketch(df, ["a", "b"], "i"), [], ["a", "b"]), ["level", "a", "b"])
    got = {(r["level"], r["a"], r["b"]): r["n_distinct"] for r in out.collect()}
    assert got == {(0, "x", "p"): 1, (0, "x", "q"): 2, (0, None, "q"): 1, (1, "x", None): 2, (1, None, None): 1, (2, None, "p"): 1, (2, None, "q"): 3, (3, None, None): 3}


def test_nothing_and_bad_sizes(spark):
    empty = spark.createDataFrame([], "k string, i string")
    assert estimate(sketch(empty, ["k"], "i"), ["k"]).count() == 0
    with pytest.raises(ValueError):
        sketch(empty, ["k"], "i", m=1000)


def test_estimator_is_unbiased():
    rng = np.random.default_rng(1)
    m, n, ones = 1024, 20_000, []
    for _ in range(60):
        bits = np.zeros((m, RANKS), bool)
        bits[rng.integers(0, m, n), np.minimum(rng.geometric(0.5, n) - 1, RANKS - 1)] = True
        ones.append(bits.sum(0))
    got, err = fit(np.array(ones, float), m)
    assert got.mean() == pytest.approx(n, rel=0.01) and got.std() == pytest.approx(err.mean(), rel=0.35)
