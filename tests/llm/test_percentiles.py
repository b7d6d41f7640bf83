"""Exact bisection and mergeable counts against brute force."""

import math
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.llm.percentiles import merge_counts, percentiles, value_counts

PROBS = (0.0, 0.1, 0.5, 0.9, 1.0)


def brute(rows, probs=PROBS):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return {(k, q): (len(v), sorted(v)[max(1, math.ceil(round(q * len(v), 9))) - 1]) for k, v in groups.items() for q in probs}


def run(df, keys=("k",), **options):
    out = percentiles(value_counts(df, list(keys), F.col("v")), list(keys), PROBS, **options)
    return {(r["k"] if keys else None, r["q"]): (r["n"], r["value"]) for r in out.collect()}


def rows_of(seed):
    rng = random.Random(seed)
    values = [None, D("0.00"), D("-5.25"), D("9999999999999999.99"), D("0.01"), *[D(rng.randrange(-10**rng.randrange(1, 9), 10**9)) / 100 for _ in range(60)]]
    return [(rng.choice(["a", "b", None, "c"]), rng.choice(values)) for _ in range(400)] + [("one", D("1.00")), ("same", D("2.00")), ("same", D("2.00")), ("none", None)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("options", [{}, {"sections": 2}, {"rows_per_task": 3}])
def test_equals_brute_force(spark, seed, options):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, v decimal(18,2), n int")
    assert run(df, **options) == brute(rows)


def test_tolerance_bounds_the_error(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "k string, v decimal(18,2)")
    exact, near = brute(rows), run(df, tolerance=1000.0)
    assert all(0 <= near[k][1] - exact[k][1] <= 1000 for k in exact)


def test_partials_of_days_combine(spark):
    rows = rows_of(3)
    days = spark.createDataFrame([(i % 4, *r) for i, r in enumerate(rows)], "day int, k string, v decimal(18,2)")
    parts = value_counts(days, ["day", "k"], F.col("v"))
    out = percentiles(merge_counts(parts, ["k"]), ["k"], PROBS)
    assert {(r["k"], r["q"]): (r["n"], r["value"]) for r in out.collect()} == brute(rows)


def test_no_keys_and_nothing(spark):
    df = spark.createDataFrame([("a", D(i)) for i in range(10)], "k string, v decimal(18,2)")
    assert run(df, ())[None, 0.5] == (10, D(4))
    assert run(df.filter("false")) == {} and run(df.filter("false"), ()) == {}


@pytest.mark.parametrize("rows_per_task", (2, 1000))
@pytest.mark.parametrize("kind", ("double", "float", "bigint", "int", "decimal(18,18)", "decimal(38,20)", "decimal(30,2)"))
def test_values_keep_their_type(spark, kind, rows_per_task):
    rng = random.Random(11)
    if kind in ("double", "float"):
        pool = [0.0, -0.0, 1.5, -1.5, 2.0**-20, 3.25, -(2.0**20), 0.123456789 if kind == "double" else 0.125, math.inf, -math.inf]
    elif kind == "bigint":
        pool = [0, -1, 2**62, -(2**62), 2**63 - 1, -(2**63), 5, 7]
    elif kind == "int":
        pool = [0, -1, 2**31 - 1, -(2**31), 9]
    else:
        pool = [D("0.000000000000000001"), D("-0.999999999999999999"), D("0.5"), D("0"), D("0.25")] if "18,18" in kind else [D("0.01"), D("123456789012345678.25"), D("-123456789012345678.5"), D("0")] if "38" not in kind else [D("1E-20"), D("2E-20"), D("-5.5"), D("123456789012345678")]
    rows = [(rng.choice("ab"), rng.choice(pool)) for _ in range(60)]
    df = spark.createDataFrame(rows, f"k string, v {kind}")
    out = percentiles(value_counts(df, ["k"], F.col("v")), ["k"], PROBS, rows_per_task=rows_per_task)
    assert dict(out.dtypes)["value"] == kind
    assert {(r["k"], r["q"]): (r["n"], r["value"]) for r in out.collect()} == brute(rows)


@pytest.mark.parametrize("rows_per_task", (2, 1000))
def test_nan_lies_above_all(spark, rows_per_task):
    df = spark.createDataFrame([(math.nan, x) for x in (1.0, math.inf, math.nan, math.nan, -math.inf)], "k double, v double")
    got = {r["q"]: r["value"] for r in percentiles(value_counts(df, ["k"], F.col("v")), ["k"], (0.2, 0.4, 0.6, 0.8), rows_per_task=rows_per_task).collect()}
    assert got.pop(0.8) != got.get(0.8) and got == {0.2: -math.inf, 0.4: 1.0, 0.6: math.inf}


def test_groups_of_many_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = rows_of(9)
        assert run(spark.createDataFrame(rows, "k string, v decimal(18,2)")) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("at_once", (1, 5, 10**6))
def test_groups_are_taken_whole(at_once, monkeypatch):
    import pyarrow as pa

    from tidemark.llm import percentiles as module

    monkeypatch.setattr(module, "AT_ONCE", at_once)
    rng = random.Random(1)
    rows = sorted((g, rng.randrange(-50, 50)) for g in (1, 2, 3, None) for _ in range(rng.randrange(1, 40)) if g)
    batches = [pa.RecordBatch.from_pydict({"k0": [g for g, _ in rows[i : i + 3]], "v": [v for _, v in rows[i : i + 3]], "n": [1] * len(rows[i : i + 3])}) for i in range(0, len(rows), 3)]
    out = [r for b in module._local(["k0"], "bigint", tuple(D(str(p)) for p in PROBS), 0.0)(iter(batches)) for r in b.to_pylist()]
    assert {(r["k0"], PROBS[r["i"]]): (r["total"], r["v"]) for r in out} == brute(rows)
    assert list(module._local(["k0"], "bigint", (D("0.5"),), 0.0)(iter([]))) == []
