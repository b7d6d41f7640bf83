"""Micro-fixtures of the audit: mart, contract, RFM, cohorts and views."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts as co
from tidemark.operators import lenses as le
from tidemark.operators import mart as ma
from tidemark.operators import models as mo
from tidemark.operators import rfm as rf

PERIODS = "customer_id string, period_start timestamp_ntz, period_end timestamp_ntz, total_orders bigint, total_spend decimal(18,2), total_margin decimal(18,2), total_quantity bigint, last_transaction_ts timestamp_ntz"
RFM = "customer_id string, recency_days int, frequency int, monetary decimal(18,2), total_spend decimal(18,2)"


def ts(y, m, d=1, h=0, mi=0):
    return dt.datetime(y, m, d, h, mi)


def month(c, m, orders, spend, margin="0", last=None, y=2023):
    return (c, ts(y, m), ts(y + m // 12, m % 12 + 1), orders, D(spend), D(margin), 1, last)


def at(value):
    return F.lit(value).cast("timestamp_ntz")


def test_mart(spark):
    rows = [("A-1", "123", 1, ts(2024, 1, 4, 10, 2), "SKU-1", 2, D(30), None), ("A-1", "123", 2, ts(2024, 1, 4, 10, 5), "SKU-2", 1, D(15), D(10)), ("B-1", "456", 1, ts(2024, 4, 12, 15, 20), "SKU-3", 3, D(10), None), ("C-1", "789", 1, ts(2024, 12, 15, 9), "SKU-4", 1, D(50), None), ("X", "1", 1, ts(2024, 1, 1), "", -1, D(1), None)]
    lines = spark.createDataFrame(rows, "order_id string, customer_id string, line_no int, event_ts timestamp_ntz, product_id string, quantity int, unit_price decimal(18,2), unit_cost decimal(18,2)")
    orders = ma.aggregate_orders(ma.valid_lines(lines))
    a = orders.filter("order_id = 'A-1'").first()
    assert orders.count() == 3
    assert (a["total_spend"], a["total_margin"], a["total_quantity"], a["distinct_products"]) == (D("75.00"), D("65.00"), 3, 2)
    assert (a["order_ts"], a["last_item_ts"]) == (ts(2024, 1, 4, 10, 2), ts(2024, 1, 4, 10, 5))
    quarters = ma.aggregate_periods(orders, ("quarter",))
    p = quarters.filter("customer_id = '123'").first()
    assert quarters.count() == 3 and (p["period_start"], p["period_end"], p["last_transaction_ts"]) == (ts(2024, 1), ts(2024, 4), ts(2024, 1, 4, 10, 2))


def test_rounding_is_staged(spark):
    rows = [("o", "c", i, ts(2024, 1), "p", 1, None, None, D("0.0049")) for i in range(2)] + [("q", "c", 1, ts(2024, 1), "p", 1, None, None, D("0.0050"))]
    lines = spark.createDataFrame(rows, "order_id string, customer_id string, line_no int, event_ts timestamp_ntz, product_id string, quantity int, unit_price decimal(18,2), unit_cost decimal(18,2), line_total decimal(18,4)")
    orders = ma.aggregate_orders(ma.valid_lines(lines))
    assert sorted(r["total_spend"] for r in orders.collect()) == [D("0.01"), D("0.01")]
    assert ma.aggregate_periods(orders).first()["total_spend"] == D("0.02")


def test_contract(spark):
    rows = [("123", ts(2024, 1, 1, 12), "crm", None, {"loyalty": "gold", "k": "old"}), ("123", ts(2024, 2, 1, 9), "erp", False, {"region": "emea", "k": "new"}), ("456", ts(2023, 7, 10), None, None, {}), (None, None, "crm", True, None), ("9", ts(1900, 1), "crm", True, None)]
    df = spark.createDataFrame(rows, "customer_id string, acquisition_ts timestamp_ntz, source_system string, is_visible boolean, metadata map<string,string>")
    m = {r["customer_id"]: r for r in co.merge_identifiers(df).collect()}
    assert (m["123"]["acquisition_ts"], m["123"]["is_visible"], m["123"]["source_system"]) == (ts(2024, 1, 1, 12), True, "crm")
    assert m["123"]["metadata"] == {"loyalty": "gold", "region": "emea", "k": "new"} and m["456"]["metadata"] == {}
    bad = {(r[0], r[1]) for r in co.contract_violations(df, at("2025-01-01")).collect()}
    assert {("9", "acquisition_ts before 1970"), (None, "customer_id missing"), ("456", "source_system missing"), ("123", "not visible")} <= bad


def test_rfm(spark):
    df = spark.createDataFrame([month("C1", 1, 3, "150"), month("C1", 3, 2, "100"), month("C2", 1, 1, "10", last=ts(2023, 1, 5)), month("C2", 2, 1, "10")], PERIODS)
    out = {r["customer_id"]: r for r in rf.rfm(df, at("2023-04-15")).collect()}
    assert (out["C1"]["frequency"], out["C1"]["total_spend"], out["C1"]["monetary"], out["C1"]["recency_days"]) == (5, D("250.00"), D("50.00"), 14)
    assert out["C2"]["recency_days"] == 100  # any exact time beats period ends
    assert rf.future_activity(rf.rfm(df, at("2023-01-01"))).count() == 2


def test_scores(spark):
    rows = [("C1", 10, 5, D(50), D(250)), ("C2", 30, 2, D(75), D(150)), ("C3", 5, 10, D(100), D(1000)), ("C4", 50, 1, D(25), D(25)), ("C5", 20, 8, D(80), D(640))]
    scored = {r["customer_id"]: r["rfm_score"] for r in rf.rfm_scores(spark.createDataFrame(rows, RFM)).collect()}
    assert scored == {"C1": "432", "C2": "223", "C3": "555", "C4": "111", "C5": "344"}
    same = spark.createDataFrame([(c, r, 5, m, m) for c, r, _, m, _ in rows[:3]], RFM)
    assert {r["f_score"] for r in rf.rfm_scores(same).collect()} == {3}


def test_lens1_of_nothing(spark):
    row = le.lens1(spark.createDataFrame([], RFM)).first()
    assert row["total_customers"] == 0 and row["total_revenue"] == 0 and row["top_10pct_revenue_share"] == 0


def test_pareto(spark):
    rows = [(f"c{i}", 1, 1, D(v), D(v)) for i, v in enumerate([70, 10, 10, 5, 5])]
    shares = {r["percent"]: r["revenue_share"] for r in le.pareto(spark.createDataFrame(rows, RFM), (10, 40, 100)).collect()}
    assert shares == {10: D("70.00"), 40: D("80.00"), 100: D("100.00")}
    with pytest.raises(ValueError):
        le.pareto(spark.createDataFrame(rows, RFM), (0,))


def test_lens2_with_history(spark):
    one = spark.createDataFrame([("C1", 1, 5, D(50), D(250))], RFM)
    two = spark.createDataFrame([("C1", 1, 3, D(60), D(180)), ("C2", 1, 1, D(100), D(100)), ("C3", 1, 1, D(150), D(150))], RFM)
    history = spark.createDataFrame([("C1", 1, 5, D(50), D(250)), ("C2", 1, 1, D(1), D(1))], RFM)
    r = le.lens2(one, two, history).first()
    assert (r["retained"], r["churned"], r["new"], r["reactivated"]) == (1, 0, 2, 1)
    assert (r["retention_rate"], r["reactivation_rate"], r["customer_count_change"], r["revenue_change_pct"], r["aov_change_pct"]) == (D("100.00"), D("33.33"), 2, D("72.00"), D("72.00"))
    assert le.lens2(one, two).first()["reactivated"] == 0


COHORT3 = [month("C1", 1, 2, "100"), month("C2", 1, 1, "50"), month("C3", 1, 1, "75"), month("C1", 2, 1, "75"), month("C3", 2, 2, "100"), month("C1", 3, 1, "50")]


def test_lens3_and_gaps(spark):
    assigned = spark.createDataFrame([(c, "k") for c in ("C1", "C2", "C3")], "customer_id string, cohort_id string")
    cohorts = spark.createDataFrame([("k", ts(2023, 1))], "cohort_id string, start_date timestamp_ntz")
    rows = le.lens3(spark.createDataFrame(COHORT3, PERIODS), assigned, cohorts).orderBy("period_number").collect()
    assert [(r["active_customers"], r["cumulative_activation_rate"], r["total_revenue"]) for r in rows] == [(3, 1.0, D("225.00")), (2, 1.0, D("175.00")), (1, 1.0, D("50.00"))]
    assert [round(r["orders_per_member"], 4) for r in rows] == [1.3333, 1.0, 0.3333]
    gap = le.lens3(spark.createDataFrame([r for r in COHORT3 if r[1].month != 2], PERIODS), assigned, cohorts).collect()
    assert sorted(r["period_number"] for r in gap) == [0, 1]


def test_lens4(spark):
    assigned = spark.createDataFrame([("c1", "x"), ("c2", "x")], "customer_id string, cohort_id string")
    rows = spark.createDataFrame([month("c1", 1, 1, "100", "20"), month("c2", 1, 10, "50", "10")], PERIODS)
    r = le.decomposition(rows, assigned).first()
    assert (r["pct_active"], r["aof"], r["aov"], r["margin_pct"], r["total_revenue"]) == (D("100.00"), D("5.50"), D("13.64"), D("20.00"), D("30.01"))
    two = spark.createDataFrame([("cust1", "2024-Q1"), ("cust2", "2024-Q2")], "customer_id string, cohort_id string")
    p = spark.createDataFrame([month("cust1", 1, 2, "100", "20", y=2024), month("cust1", 2, 1, "50", "10", y=2024), month("cust2", 4, 3, "150", "30", y=2024)], PERIODS)
    left = le.decomposition(p, two, margin=False)
    assert sorted((r["cohort_id"], r["period_number"]) for r in left.collect()) == [("2024-Q1", 0), ("2024-Q1", 1), ("2024-Q2", 0)]
    pair = le.compare_cohorts(left).collect()
    assert len(pair) == 1 and (pair[0]["revenue_delta"], pair[0]["revenue_change_pct"]) == (D("50.000000"), D("50.00"))
    second = {r["cohort_id"]: r for r in le.time_to_second(p, two).collect()}
    assert (second["2024-Q1"]["repeat_customers"], second["2024-Q1"]["median_days"], second["2024-Q2"]["repeat_rate"]) == (1, 31.0, D("0.00"))


def test_lens5(spark):
    p = spark.createDataFrame([month("C1", 1, 5, "500", y=2024), month("C2", 1, 4, "400", y=2024), month("C3", 2, 3, "300", y=2024), month("C4", 2, 2, "200", y=2024)], PERIODS)
    a = spark.createDataFrame([("C1", "2024-Q1"), ("C2", "2024-Q1"), ("C3", "2024-Q2"), ("C4", "2024-Q2"), ("C5", "2024-Q2")], "customer_id string, cohort_id string")
    r = le.health(p, a).first()
    assert (r["retention_rate"], r["repeat_trend"], r["revenue_predictability_pct"], r["acquisition_dependence_pct"], r["health_score"], r["health_grade"]) == (D("80.00"), "stable", D("64.29"), D("35.71"), D("64.72"), "D")
    assert {x["cohort_size"] for x in le.repeat_behaviour(p, a).collect()} == {2}
    rows = [(100, "improving", 100, 0), (75, "stable", 60, 30), (50, "declining", 40, 50), (85, "improving", 75, 20)]
    s = spark.createDataFrame(rows, "r int, t string, p int, d int").select(le.health_score(F.col("r"), F.col("t"), F.col("p"), F.col("d")).alias("s"))
    assert [x["s"] for x in s.collect()] == [D("94.00"), D("63.50"), D("39.00"), D("80.50")]


def test_cohort_assignment(spark):
    defs = spark.createDataFrame([("a", ts(2023, 1), ts(2023, 4), 0), ("b", ts(2023, 3), ts(2023, 7), 1)], "cohort_id string, start_date timestamp_ntz, end_date timestamp_ntz, ord int")
    people = spark.createDataFrame([("p", ts(2023, 1)), ("q", ts(2023, 3, 15)), ("r", ts(2023, 4)), ("s", ts(2023, 7)), ("n", None)], "customer_id string, acquisition_ts timestamp_ntz")
    assert {r[0]: r[1] for r in co.assign_cohorts(people, defs).collect()} == {"p": "a", "q": "a", "r": "b"}
    assert [tuple(r) for r in co.overlaps(defs).collect()] == [("a", "b")]
    assert co.coverage(people, co.assign_cohorts(people, defs)).first()["unassigned"] == 2


def test_model_inputs_and_fits(spark):
    df = spark.createDataFrame([month("C1", 1, 3, "150"), month("C1", 3, 2, "100")], PERIODS)
    r = mo.bgnbd_inputs(df, at("2023-04-15")).first()
    assert (r["frequency"], r["recency"], r["T"]) == (4, 90.0, 104.0)
    g = mo.gamma_gamma_inputs(df).first()
    assert (g["frequency"], g["monetary_value"]) == (5, D("50.00"))


def test_models_recover_their_parameters(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    n, end, true = 4000, 400.0, (0.9, 20.0, 0.8, 3.0)
    rows = []
    for lam, p in zip(rng.gamma(true[0], 1 / true[1], n), rng.beta(true[2], true[3], n)):
        now, x, last = 0.0, 0, 0.0
        while (now := now + rng.exponential(1 / lam)) < end:
            x, last = x + 1, now
            if rng.random() < p:
                break
        rows.append((x, last, end))
    df = spark.createDataFrame([(f"c{i}", int(a), float(b), float(c)) for i, (a, b, c) in enumerate(rows)], "customer_id string, frequency int, recency double, T double")
    fit = mo.fit_bgnbd(df)
    assert fit.r == pytest.approx(true[0], rel=0.25) and fit.alpha == pytest.approx(true[1], rel=0.3)
    scored = df.select(mo.prob_alive(fit).alias("p"), mo.expected_purchases(fit, 365.25)("frequency", "recency", "T").alias("e")).toPandas()
    assert scored["p"].between(0, 1).all() and (scored["e"] >= 0).all()
    q = rng.gamma(4.0, 1 / 30.0, n)  # spend rates
    x = rng.integers(1, 12, n)
    spend = np.round(rng.gamma(6.0 * x, 1 / (q * x)), 2)
    gg = mo.fit_gamma_gamma(spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, spend)], "frequency int, monetary_value double"))
    assert gg.p == pytest.approx(6.0, rel=0.25) and gg.q == pytest.approx(4.0, rel=0.25)


def test_expected_purchases_of_many_and_few(spark):
    import numpy as np

    model, horizon = mo.BgNbd(0.8, 40.0, 1.4, 3.0), 100.0
    df = spark.createDataFrame([(0.0, 0.0, 300.0), (3.0, 200.0, 300.0), (20_000.0, 299.0, 300.0)], "frequency double, recency double, T double")
    got = [r[0] for r in df.select(mo.expected_purchases(model, horizon)("frequency", "recency", "T")).collect()]
    for (x, tx, t), value in zip([(0.0, 0.0, 300.0), (3.0, 200.0, 300.0)], got):  # the untransformed form
        series = float(mo.hyp2f1(np.array(0.8 + x), 3.0 + x, 1.4 + 3.0 + x - 1, horizon / (40 + t + horizon)))
        grown = (1.4 + 3.0 + x - 1) / 0.4 * (1 - ((40 + t) / (40 + t + horizon)) ** (0.8 + x) * series)
        alive = 1 / (1 + (x > 0) * 1.4 / max(3.0 + x - 1, 1e-9) * ((40 + t) / (40 + tx)) ** (0.8 + x))
        assert value == pytest.approx(grown * alive, rel=1e-8)
    assert np.isfinite(got[2]) and got[2] > 0


def test_series_does_not_overflow():
    import numpy as np

    assert mo.hyp2f1(1.0, 1.0, 2.0, 0.5) == pytest.approx(2 * np.log(2))
    a, z = 1000.0, 0.9
    assert mo.hyp2f1(a, 2.0, 2.0, z, a * np.log1p(-z)) == pytest.approx(1.0)  # (1 - z)^-a, scaled back
