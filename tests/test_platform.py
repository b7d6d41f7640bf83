"""Cube, federation, expressions, statistics, lineage, workflow, sources and streaming on small fixtures."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.functions.expressions import compile_expression
from tidemark.functions.exprs import md5_mod
from tidemark.operators import drift as dr
from tidemark.operators import experiments as ex
from tidemark.operators import federate as fe
from tidemark.operators import lineage as li
from tidemark.operators import olap
from tidemark.operators import quality as qu
from tidemark.operators import workflow as wf
from tidemark.operators.ordered import sums_before
from tidemark.sources import files, synthetic
from tidemark.sources.warehouse import Catalog, Factory, guard_identifier
from tidemark.streaming import events as ev
from tidemark.streaming import windows as wi


def test_md5_modulo(spark):
    assert spark.range(1).select(md5_mod(F.lit("exp:u1"), 10_000)).first()[0] == 5246


def test_expressions_follow_python(spark):
    rows = [(7.0, -3.0), (-7.0, 3.0), (2.5, 2.0), (1.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    out = df.select(compile_expression("a % b", df.columns), compile_expression("a // b", df.columns), compile_expression("round(a)", df.columns)).collect()
    assert [tuple(r) for r in out[:3]] == [(a % b, a // b, round(a)) for a, b in rows[:3]] and out[3][0] is None
    for bad in ("a.b", "__import__('os')", "c + 1", "a if b else 1", "abs(x=1)"):
        with pytest.raises((ValueError, SyntaxError)):
            compile_expression(bad, df.columns)


def test_running_sums(spark):
    df = spark.createDataFrame([(float(i), i % 7) for i in range(200)], "x double, n int")
    for down in (False, True):
        rows = {r["x"]: r["n_before"] for r in sums_before(df, "x", ["n"], descending=down, buckets=8).collect()}
        order, total = sorted(range(200), reverse=down), 0
        for i in order:
            assert rows[float(i)] == total
            total += i % 7


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.chi2_tail(3.84, 1) == pytest.approx(0.0500435, abs=1e-6) and tails.chi2_tail(30, 4) == pytest.approx(4.894e-06, rel=1e-3)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6) and tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.kolmogorov_tail(1.0, 3, 3) == pytest.approx(0.1) and tails.kolmogorov_tail(0.0, 5, 5) == 1.0
    assert tails.kolmogorov_tail(0.1, 500, 500) == pytest.approx(0.0135, abs=0.002)


def test_drift(spark):
    a = spark.range(2000).select(F.col("id").cast("double").alias("x"))
    shifted = a.select((F.col("x") + 900).alias("x"))
    long = lambda df: dr.long_form(df, ["x"])
    assert dr.psi(long(a), long(a)).first()["psi"] == pytest.approx(0.0, abs=1e-12)
    assert dr.psi(long(a), long(shifted)).first()["psi"] > 0.25
    few = a.limit(5)
    assert dr.psi(long(few), long(a)).first()["psi"] is None
    constant = a.select(F.lit(1.0).alias("x"))
    assert dr.psi(long(constant), long(a)).first()["psi"] == 0.0
    same = dr.ks_test(a, a, "x")
    assert same["statistic"] == 0 and same["p_value"] == 1.0 and not same["drift"]
    assert dr.ks_test(a, shifted, "x")["drift"] and dr.ks_test(a, shifted, "x")["statistic"] == pytest.approx(0.45)
    assert dr.model_psi(constant, constant, "x").first()[0] == 0 and dr.model_psi(constant, constant.select((F.col("x") + 1).alias("x")), "x").first()[0] == 1
    with pytest.raises(ValueError):
        dr.feature_drift(a, shifted.withColumnRenamed("x", "y"), ["x"])


def test_tests_on_moments(spark):
    rows = [("a", float(i % 10)) for i in range(100)] + [("b", float(i % 10) + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v double")
    m = ex.moments(df, "g", "v")
    t = ex.t_test(m["a"], m["b"])
    assert t["statistic"] == pytest.approx(1 / math.sqrt(2 * 8.333333 / 100), rel=1e-4) and t["low"] < 1 < t["high"]
    u = ex.mann_whitney(df, "g", "v", "a", "b")
    brute = sum((x > y) + 0.5 * (x == y) for g, x in rows if g == "a" for h, y in rows if h == "b")
    assert u["statistic"] == brute
    assert ex.sequential(ex.Moments(100, 10, 2), ex.Moments(100, 12, 2))["decision"] == "reject_h0"
    assert ex.proportions(50, 100, 50, 100)["p_value"] == pytest.approx(1.0)
    assert ex.sample_size(0.5) == pytest.approx(64, abs=1) and ex.smallest_effect(64) == pytest.approx(0.5, abs=0.01)
    c = ex.chi2_contingency(spark.createDataFrame([("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 20 + [("y", "q")] * 10, "r string, c string"), "r", "c")
    assert c["statistic"] == pytest.approx(5.4) and c["df"] == 1  # with Yates


def test_cube_operations(spark):
    cube = olap.Cube((olap.Dimension("region", "region"), olap.Dimension("place", "city", levels=(("region", "region"), ("city", "city")))), (olap.Measure("revenue", "v"),))
    df = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("s", "c", 4), ("s", None, 8)], "region string, city string, v int")
    q = olap.CubeQuery((("place", "city"),), ("revenue",))
    assert {tuple(r) for r in olap.execute(df, cube, q, olap.drill_up("place")).collect()} == {("n", 3), ("s", 12)}
    assert olap.execute(df, cube, q, olap.drill_up("place"), olap.drill_up("place")).first()[0] == 15
    assert {tuple(r) for r in olap.execute(df, cube, q, olap.slice_("region", "s")).collect()} == {("c", 4), (None, 8)}
    with pytest.raises(ValueError):
        olap.execute(df, cube, q, olap.slice_("nothing", 1))
    with pytest.raises(ValueError):
        olap.execute(df, cube, q, olap.drill_down("region"))
    assert olap.discover(df).measures == (olap.Measure("v", "v"),)
    assert olap.discover(df.select("city")).measures[0].name == "record_count"


def test_federated_join(spark):
    a = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "none", 3)], "k int, a string, ord int")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, "w")], "k int, a string")
    out = fe.federated_join({"a": a, "b": b}, ["k"])
    assert {(r["k"], r["a"], r["b_a"]) for r in out.collect()} == {(1, "new", "x"), (1, "new", "y"), (None, "none", "z")}
    c = spark.createDataFrame([(9,)], "other int")
    assert fe.federated_join({"a": a, "c": c}, ["k"]).count() == 3
    union = fe.federated_union([a, b, c.withColumnRenamed("other", "k")])
    assert union.columns == a.columns and union.count() == 8


def test_failing_source_is_kept_apart(spark):
    waits = []

    def fail():
        waits.append(1)
        raise OSError("down")

    q = fe.FederatedQuery({"a": (1, lambda: spark.range(3)), "b": (5, fail)}, retries=2, wait=0.0)
    assert list(q.fetch()) == ["a"] and len(waits) == 3 and "down" in q.errors["b"] and q.execution_order() == ["b", "a"]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (1, "a"), (None, None), (None, None)], "id int, name string")
    suite = [qu.Expectation("unique", "id"), qu.Expectation("not_null", "name"), qu.Expectation("columns_match_ordered", options={"columns": ("id", "name")}), qu.Expectation("row_count_between", options={"low": 9})]
    got = {r["kind"]: (r["success"], r["observed"]) for r in qu.run_suite(df, suite).collect()}
    assert got == {"unique": (False, 2), "not_null": (False, 3), "columns_match_ordered": (True, 2), "row_count_between": (False, 5)}
    assert qu.profile(df).first()["duplicate_rows"] == 2
    perfect = qu.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "actual double, predicted double")).first()
    assert perfect["mae"] == 0 and perfect["r_squared"] == 1
    off = qu.regression_metrics(spark.createDataFrame([(10.0, 15.0), (20.0, 10.0)], "actual double, predicted double")).first()
    assert float(off["mae"]) == 7.5
    assert qu.model_quality(spark.createDataFrame([], "a int, b string"), ["a", "b"]).first()["total_samples"] == 0


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "d"), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r["node"], r["distance"]) for r in li.reach(edges, start).collect()} == {("b", 1), ("c", 2), ("d", 3), ("a", 3)}
    assert {r["node"] for r in li.reach(edges, start, 1).collect()} == {"b"}
    assert li.shortest_path(edges, "a", "d") == ["a", "b", "c", "d"] and li.shortest_path(edges, "d", "a") is None
    assert {r["id"] for r in li.on_cycles(edges).collect()} == {"a", "b", "c"}
    assert li.reach(edges, spark.createDataFrame([("zz",)], "id string")).count() == 0
    assert '"a" -> "b"' in li.dot(start, edges)


def test_workflow():
    runs = []

    def flaky(_):
        runs.append(1)
        if len(runs) < 3:
            raise RuntimeError("again")
        return 5

    dag = wf.Dag().add(wf.Task("a", flaky, retries=3)).add(wf.Task("b", lambda r: r["a"] + 1, ("a",))).add(wf.Task("c", lambda r: 1 / 0)).add(wf.Task("d", lambda r: 1, ("c",))).add(wf.Task("e", lambda r: 1, ("d",))).add(wf.Task("s", lambda r: 1, skip_if=lambda r: True))
    assert dag.execute(sleep=lambda s: None) == {"a": "succeeded", "b": "succeeded", "c": "failed", "d": "upstream_failed", "e": "upstream_failed", "s": "skipped"}
    assert dag.order().index("a") < dag.order().index("b")
    with pytest.raises(ValueError):
        wf.Dag().add(wf.Task("x", print, ("y",))).add(wf.Task("y", print, ("x",))).order()
    assert wf.delay_linear(3) == 3 and wf.delay_polynomial(3) == 9 and 270 <= wf.delay_exponential(20) <= 330


def test_catalog(spark, tmp_path):
    for bad in ("a;b", "last_update", "x--", "1a", "a" * 129, "", "a b"):
        with pytest.raises(ValueError):
            guard_identifier(bad)
    spark.range(5).write.parquet(str(tmp_path / "n.parquet"))
    catalog = Catalog(spark, {"n": str(tmp_path / "n.parquet")})
    run = catalog.submit("SELECT sum(id) AS s FROM n WHERE id > :low", {"low": 2})
    assert catalog.result(run)[0]["s"] == 7 and catalog.status(run) == "completed"
    f = Factory()
    f.register("files", lambda root: Catalog(spark, {"n": root}), ("root",))
    with pytest.raises(ValueError):
        f.create("files", {})
    assert f.create("FILES", {"root": str(tmp_path / "n.parquet")}).table("n").count() == 5


def test_sources(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[{"order_id": "1", "customer_id": "a", "event_ts": "2024-01-02T03:04:05Z", "quantity": 2, "unit_price": 3.5}, {"order_id": "2", "event_ts": "bad"}]')
    rows = files.read_transactions(spark, str(path), jail=str(tmp_path)).collect()
    assert rows[0]["event_ts"] == dt.datetime(2024, 1, 2, 3, 4, 5) and rows[1]["event_ts"] is None
    with pytest.raises(ValueError):
        files.read_transactions(spark, str(path), jail=str(tmp_path / "other"))
    with pytest.raises(ValueError):
        files.read_by_suffix(spark, "x.xlsx")
    assert files.records_of({"results": [1]}) == [1] and files.records_of([2]) == [2] and files.records_of({"a": 1}) == [{"a": 1}]


def test_http_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"items": [{"a": 1, "b": "x"}, {"a": 2}]}')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(files.HttpSource)
    df = spark.read.format("http_json").schema("a string, b string").option("url", f"http://127.0.0.1:{server.server_port}/").load()
    assert [tuple(r) for r in df.collect()] == [("1", "x"), ("2", None)]
    server.shutdown()


def test_synthetic(spark):
    people = synthetic.customers(spark, 50, "2023-01-01", "2023-06-30")
    one, two = (synthetic.transactions(p, "2023-01-01", "2023-12-31") for p in (people, people.repartition(7)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() > 50
    assert sum(synthetic.allocate(7, {"a": 1, "b": 1, "c": 1}).values()) == 7


def test_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=30 * i), str(i % 5)) for i in range(200)] + [(999, base + dt.timedelta(days=1), "1")]
    df = spark.createDataFrame(rows, "id int, ts timestamp, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    columns = wi.aggregates(F.col("value"), "ts", streaming=True)
    q = wi.tumbling(stream, "ts", "10 minutes", [], columns).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = wi.tumbling(df, "ts", "10 minutes", [], columns).filter("window_start < timestamp'2024-01-01 23:00:00'")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


def test_windows_are_half_open_and_sessions_merge(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base,), (base + dt.timedelta(minutes=1),), (base + dt.timedelta(minutes=10),), (base + dt.timedelta(minutes=5, seconds=30),)]
    df = spark.createDataFrame(rows, "ts timestamp").withColumn("value", F.lit("oops"))
    columns = wi.aggregates(F.col("value"), "ts")
    tumbling = wi.tumbling(df, "ts", "1 minute", [], columns).orderBy("window_start").collect()
    assert [r["count"] for r in tumbling] == [1, 1, 1, 1] and tumbling[0]["sum"] == 0 and tumbling[0]["min"] is None
    assert [r["count"] for r in wi.session(df, "ts", [], columns, "5 minutes").collect()] == [4]


def test_dead_letters(spark, tmp_path):
    raw = spark.createDataFrame([('{"event_id": "1", "event_type": "custom", "timestamp": "1704067200"}',), ("nonsense",), ('{"event_id": "2", "event_type": "transaction", "timestamp": "2024-01-01T00:00:00Z", "payload": "{\\"amount\\": 1}"}',)], "value string")
    raw.coalesce(1).write.text(str(tmp_path / "in"))
    good, dead = [], []
    sink = ev.split_sink(lambda df, i: good.extend(df.collect()), lambda df, i: dead.extend(df.collect()))
    stream = ev.parse(spark.readStream.text(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["event_id"] for r in good] == ["1"] and good[0]["ts"] == dt.datetime(2024, 1, 1)
    assert {tuple(r["errors"]) for r in dead} == {("no event_id", "unknown event_type", "no time"), ("payload lacks transaction_id",)}
