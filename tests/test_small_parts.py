"""The result cache, adapters, report texts, routing and redaction."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import redact, sha256_key
from tidemark.functions.rows import attach
from tidemark.operators import adapters as ad
from tidemark.operators import features as fs
from tidemark.operators import labels as la
from tidemark.operators.cache import ResultCache, cache_key
from tidemark.sources import sinks


def test_cache_policies():
    now = [0.0]
    c = ResultCache(entries_most=2, policy="lru", clock=lambda: now[0])
    assert not c.put("fast", 1, took=0.5, size=1) and c.get("fast") is None
    for k in "ab":
        now[0] += 1
        assert c.put(k, k, took=2, size=10)
    now[0] += 1
    assert c.get("a") == "a"
    now[0] += 1
    c.put("c", "c", took=2, size=10)
    assert c.get("b") is None and c.get("a") == "a" and c.get("c") == "c"
    now[0] += 3601
    assert c.get("a") is None
    c.put("d", 1, took=2, size=1, ttl=1)
    now[0] += 299
    assert c.get("d") == 1  # a lifetime is at least five minutes
    assert c.invalidate() >= 1 and not c.entries
    for policy, gone in (("fifo", "x"), ("size", "y"), ("ttl", "x"), ("hybrid", "y")):
        c = ResultCache(entries_most=2, policy=policy, clock=lambda: now[0])
        c.put("x", 1, took=2, size=1, ttl=400)
        now[0] += 1
        c.put("y", 1, took=2, size=50, ttl=4000)
        c.get("x")
        c.put("z", 1, took=2, size=1)
        assert gone not in c.entries, policy


def test_keys_agree(spark):
    sql, params = " SELECT  1\nFROM t ", {"k": 1}
    column = sha256_key(F.lit(sql), F.lit(json.dumps(params)))
    assert spark.range(1).select(column).first()[0] == cache_key(sql, params)
    assert spark.range(1).select(redact(F.lit("a=1 password=x, Token: 'y z' end"))).first()[0] == "a=1 password=***, Token: *** end"


def test_adapters(spark):
    df = spark.createDataFrame([("a", None, 1, 1, 1, 1)], "id string, customer_id string, t int, total_spend int, total_margin int, total_quantity int")
    out = ad.adapt(df, "orders", {"id": "order_id", "t": "order_ts"})
    assert out.columns[0] == "order_id" and {r["column"]: r["nulls"] for r in ad.null_counts(out, "orders").collect()}["customer_id"] == 1
    with pytest.raises(ValueError):
        ad.adapt(df, "rfm")


def test_reports(spark):
    df = spark.createDataFrame([("m", 0.3, True, 0.2, "x")], "metric string, drift_score double, drift_detected boolean, threshold double, interpretation string")
    assert json.loads(sinks.drift_json(df))["drifted"] == 1
    assert sinks.drift_csv(df).splitlines()[0].startswith("metric,") and "| m | 0.3000 | yes |" in sinks.drift_markdown(df)
    assert sinks.cohort_summary([]) == "There are no cohorts."
    with pytest.raises(ValueError):
        la.markdown_table(spark.range(10), most=5)


def test_routing():
    assert la.route("show churn by period") == ["lens2"] and la.route("nothing") == ["lens1"]
    assert "lens1" not in la.route("overall health score") and "lens5" in la.route("overall health score")


def test_attached_rows(spark):
    df = spark.range(3)
    out = attach(df, df.agg(F.max("id").alias("top"), F.min("id").alias("low")), df.agg(F.count(F.lit(1)).alias("n")))
    assert sorted(map(tuple, out.collect())) == [(0, 2, 0, 3), (1, 2, 0, 3), (2, 2, 0, 3)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_feature_values(spark, tmp_path):
    rows = [(1, "n", '"x"'), (2, "n", "5"), (3, "n", "5.5"), (4, "n", "99"), (5, "n", None), (6, "n", "null"), (7, "b", "maybe")]
    df = spark.createDataFrame(rows, "value_id int, feature_name string, value string")
    rules = {"n": {"type": "INTEGER", "max": 50}, "b": {"type": "BOOLEAN"}}
    assert {tuple(r) for r in fs.violations(df, rules).collect()} == {(1, "not a number"), (3, "not an integer"), (4, "above the maximum"), (7, "not a boolean")}
    bad = fs.write_values(df, str(tmp_path / "store"), rules)
    assert bad.count() == 4 and sorted(r["value_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [2, 5, 6]
    definitions = spark.createDataFrame([("tenure", "months since start", ["core"]), ("spend", "total", [])], "feature_name string, description string, tags array<string>")
    assert [r["feature_name"] for r in fs.discover(definitions, "MONTHS", ["core"]).collect()] == ["tenure"]
    with pytest.raises(ValueError):
        fs.compute(spark.range(1), {"a": (("b",), F.lit(1)), "b": (("a",), F.lit(1))})


def test_stored_tables_and_the_shared_folder(spark):
    from tidemark.session import drop_stored, shared_folder, stored

    df = stored(spark.range(5).selectExpr("id", "cast(null as string) as s"))
    assert shared_folder(spark) and df.count() == 5 and df.dtypes == [("id", "bigint"), ("s", "string")]
    path = df.inputFiles()[0]
    drop_stored()
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_hot_keys_by_broadcast_and_by_shuffle(spark):
    from tidemark.operators.skew import hot_keys

    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 3 + [("c",)] + [(None,)] * 9, "k string")
    for most in (100, 0):
        assert sorted(tuple(r) for r in hot_keys(df, ["k"], 2, most=most).collect()) == [("a", 4), ("b", 2)]
    assert hot_keys(df, ["k"], 50).count() == 0


def test_effective_size_of_known_chains():
    import numpy as np

    from tidemark.operators.models import effective_size

    rng = np.random.default_rng(3)
    independent = [rng.normal(size=4000) for _ in range(4)]
    assert 0.85 < effective_size(independent) / 16_000 < 1.2
    slow = []
    for _ in range(4):
        x, e = np.zeros(8000), rng.normal(size=8000)
        for i in range(1, 8000):
            x[i] = 0.9 * x[i - 1] + e[i]
        slow.append(x)
    assert 0.7 < effective_size(slow) / (32_000 * 0.1 / 1.9) < 1.4  # (1 - a) / (1 + a) of an autoregression
    assert effective_size([np.ones(100)] * 2) == 200 and np.isnan(effective_size([np.ones(3)]))


def test_tasks_wait_for_resources_and_results_are_checked():
    import threading
    import time

    from tidemark.operators.workflow import Dag, Pool, Task

    running, most, lock = [0], [0], threading.Lock()

    def work(_):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02)
        with lock:
            running[0] -= 1
        return 1

    dag = Dag()
    for i in range(6):
        dag.add(Task(f"t{i}", work, cpu=2, memory=1))
    dag.add(Task("large", work, cpu=9)).add(Task("odd", work, valid=lambda r: r == 2)).add(Task("good", work, valid=lambda r: r == 1, cpu=1))
    state = dag.execute(workers=9, sleep=lambda s: None, pool=Pool(cpu=4, memory=3))
    assert most[0] <= 4 and state["large"] == state["odd"] == "failed" and state["good"] == state["t5"] == "succeeded"


def test_sources_are_fetched_side_by_side(spark):
    import time

    from tidemark.operators.federate import FederatedQuery

    tries = []

    def slow(n):
        def get():
            time.sleep(0.5)
            return spark.range(n)

        return get

    def bad():
        tries.append(1)
        raise OSError("away")

    q = FederatedQuery({"a": (1, slow(1)), "b": (9, slow(2)), "c": (5, slow(3)), "x": (0, bad)}, retries=1, wait=0.01)
    began = time.time()
    got = q.fetch()
    assert time.time() - began < 1.4 and list(got) == ["a", "b", "c"] and len(tries) == 2 and q.errors == {"x": "OSError: away"}
    failing = spark.range(3).selectExpr("raise_error('broken') as v")
    q = FederatedQuery({"a": (1, lambda: spark.range(4)), "b": (1, lambda: failing)}, retries=0)
    assert [d.count() for d in q.fetch(execute=True).values()] == [4] and "broken" in q.errors["b"]


def test_reports(spark):
    import json

    from tidemark.sources.sinks import report

    df = spark.createDataFrame([(1, "a<b,"), (2, None)], "k int, t string")
    assert report(df, "csv") == 'k,t\n1,"a<b,"\n2,\n' and json.loads(report(df, "json"))["rows"] == [{"k": 1, "t": "a<b,"}, {"k": 2, "t": None}]
    assert "<td>a&lt;b,</td>" in report(df, "html")
    import pytest

    with pytest.raises(ValueError):
        report(df, "pdf")
