"""Event features and trailing totals on small fixtures."""

import datetime as dt
from decimal import Decimal

import pytest

from tidemark.operators.event_features import append_orders, cumulative_store, current_orders, event_features, feature_table
from tidemark.operators.trailing import current_periods, trailing_totals

ORDERS = "order_id string, customer_id string, order_ts timestamp_ntz, total_spend decimal(18,2), event_name string, ingested_at timestamp_ntz"
D = Decimal


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_features(spark):
    rows = [
        ("o1", "a", day(0, 5), D("10.00"), "buy", day(1)), ("o1", "a", day(0, 5), D("12.00"), "buy", day(3)), ("o1", "a", day(0, 5), D("12.00"), "buy", day(3)),
        ("o2", "a", day(40), None, "buy", day(41)), ("o3", "a", day(44, 23), D("-3.00"), None, day(50)), ("o4", None, day(1), D("5.00"), "buy", day(1)), ("o5", "b", None, D("5.00"), "buy", day(1)), ("o6", "c", day(60), D("5.00"), "buy", day(61)),
    ]
    store = cumulative_store(current_orders(spark.createDataFrame(rows, ORDERS)))
    out = {(r["entity"], r["kind"]): r for r in event_features(store, dt.date(2024, 2, 15), (7, 30)).collect()}  # day 45
    assert set(out) == {("a", "buy"), ("a", None)}  # c comes later than the date
    buy, none = out["a", "buy"], out["a", None]
    assert (buy["count"], buy["total_spend"], buy["days_since"]) == (2, D("12.00"), 5)
    assert (buy["count_7d"], buy["total_spend_7d"], buy["count_30d"], buy["total_spend_30d"]) == (1, D("0.00"), 1, D("0.00"))
    assert (none["count"], none["days_since"], none["total_spend_7d"]) == (1, 0, D("-3.00"))
    wide = feature_table(event_features(store, dt.date(2024, 2, 15), (7, 30))).collect()
    assert len(wide) == 1 and [f["kind"] for f in wide[0]["features"]] == [None, "buy"] and wide[0]["events"] == 3


def test_features_of_nothing(spark):
    empty = spark.createDataFrame([], ORDERS)
    assert feature_table(event_features(cumulative_store(current_orders(empty)), dt.date(2024, 1, 1))).count() == 0


def test_rows_without_order_id_count_once_each(spark):
    row = (None, "a", day(0), D("1.00"), "buy", day(1))
    other = (None, "a", day(0), D("2.00"), "buy", day(1))
    assert current_orders(spark.createDataFrame([row, row, other], ORDERS)).count() == 2


DAILY = "customer_id string, period_start timestamp_ntz, total_spend decimal(18,2), entity string, day string, lag int"


def brute(rows, windows):
    days = sorted({r[1].date() for r in rows if r[0] is not None and r[1] is not None})
    out = {}
    for c in {r[0] for r in rows if r[0] is not None and r[1] is not None}:
        d = days[0]
        while d <= days[-1]:
            out[c, d] = tuple(sum((r[2] or D(0) for r in rows if r[0] == c and r[1] is not None and 0 <= (d - r[1].date()).days < w), D("0.00")) for w in windows)
            d += dt.timedelta(days=1)
    return out


def test_trailing_totals(spark):
    rows = [("a", day(0), D("1.00")), ("a", day(0), D("2.00")), ("a", day(3), D("4.00")), ("b", day(9), None), ("b", day(5), D("-7.50")), (None, day(2), D("9.00")), ("c", None, D("9.00")), ("a", day(12), D("0.10"))]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DAILY)  # extra columns with the operator's own names
    got = {(r["customer_id"], r["day"]): (r["total_3d"], r["total_7d"]) for r in trailing_totals(df, (3, 7)).collect()}
    assert got == brute(rows, (3, 7))


def test_trailing_average_and_single_day(spark):
    df = spark.createDataFrame([("a", day(0), D("7.00"), "x", "y", 1)], DAILY)
    rows = trailing_totals(df).collect()
    assert len(rows) == 1 and rows[0]["avg_7d"] == pytest.approx(1.0) and rows[0]["avg_30d"] == pytest.approx(0.2333)


def test_trailing_of_nothing(spark):
    assert trailing_totals(spark.createDataFrame([], DAILY)).count() == 0
    assert trailing_totals(spark.createDataFrame([(None, day(0), D("1.00"), "x", "y", 1)], DAILY)).count() == 0


PERIODS = "period_id bigint, granularity string, period_start timestamp_ntz, customer_id string, total_spend decimal(18,2), city string, source_system string, loaded_at timestamp_ntz"


def test_current_periods(spark):
    rows = [(1, "day", day(0), "a", D("1.00"), "x", "s", day(1)), (1, "day", day(0), "a", D("2.00"), "x", "s", day(2)), (1, "day", day(0), "a", D("2.00"), "x", "s", day(2)), (None, "day", day(0), "a", D("5.00"), None, None, None), (None, "day", day(0), "a", D("5.00"), None, None, None)]
    assert sorted(r["total_spend"] for r in current_periods(spark.createDataFrame(rows, PERIODS)).collect()) == [D("2.00"), D("5.00")]


def test_trailing_of_huge_amounts_and_ties(spark):
    huge = D("99999999999999.99")
    rows = [("a", day(k), huge) for k in range(9)] + [("b", day(1), D("-0.01")), ("b", day(4), D("0.03"))]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DAILY)
    for chosen, windows in ((df, (8, 400)), (df.filter("customer_id = 'b'"), (8, 400))):  # in decimals, and in cents
        got = {(r["customer_id"], r["day"]): (r["total_8d"], r["total_400d"]) for r in trailing_totals(chosen, windows).collect()}
        want = brute([r for r in rows if chosen is df or r[0] == "b"], windows)
        assert got == want
        means = {(r["customer_id"], r["day"]): r["avg_8d"] for r in trailing_totals(chosen, windows).collect()}
        assert all(means[k] == pytest.approx(float((t[0] / 8).quantize(D("0.0001"), "ROUND_HALF_UP")), rel=1e-12) for k, t in want.items())


def test_orders_appended_in_any_order_equal_one_store(spark):
    import random

    rng = random.Random(4)
    rows = [(f"o{i}", rng.choice(["a", "b", "c", None]), rng.choice([None, *(day(d, h) for d in range(6) for h in (1, 20))]), rng.choice([None, D("1.25"), D("-2.00"), D("7.10")]), rng.choice(["buy", "see", None]), day(9)) for i in range(90)]
    rng.shuffle(rows)
    frame = lambda part: spark.createDataFrame(part, ORDERS)
    store = cumulative_store(frame(rows[:30]))
    for part in (rows[30:31], rows[31:60], [], rows[60:]):
        store = append_orders(store, frame(part))
    key = lambda df: sorted((tuple(r) for r in df.select("entity", "kind", "day", "cum_n", "cum_total", "last_us").collect()), key=str)
    assert key(store) == key(cumulative_store(frame(rows)))
