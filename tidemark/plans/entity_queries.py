"""Queries of the general training-data operators: as-of features, event features, trailing totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_features
from tidemark.operators.event_features import cumulative_store, current_orders, event_features, feature_table
from tidemark.operators.trailing import current_periods, trailing_totals
from tidemark.registry import Registry
from tidemark.session import table

REG = Registry()


@REG.query("""
WITH r AS (
  SELECT l.label_id, v.feature_name, v.value_id,
         row_number() OVER (PARTITION BY l.label_id, v.feature_name ORDER BY v.created_at DESC, v.valid_from DESC, v.value_id DESC) AS k
  FROM (SELECT DISTINCT label_id, customer_id, label_ts FROM scoring_labels) l
  JOIN feature_values v ON v.entity_id = l.customer_id AND v.valid_from <= l.label_ts
   AND (v.valid_until IS NULL OR l.label_ts < v.valid_until) AND v.created_at <= l.label_ts)
SELECT label_id, feature_name, value_id FROM r WHERE k = 1""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return asof_features(table(spark, d, "scoring_labels"), table(spark, d, "feature_values"))


def as_of_day(orders: DataFrame) -> dt.date:
    """The start of the day after the last order."""
    last = orders.agg(F.max("order_ts")).first()[0]
    return (last.date() if last else dt.date(1970, 1, 1)) + dt.timedelta(days=1)


def _features(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "order_aggregations")
    return event_features(cumulative_store(current_orders(orders)), as_of_day(orders))


@REG.query()
def p2_event_features(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(_features(spark, d)).withColumnRenamed("entity", "customer_id")


CURRENT_ORDERS = """cur AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ingested_at DESC) AS k FROM order_aggregations) WHERE k = 1),
last AS (SELECT CAST(max(order_ts) AS DATE) + 1 AS as_of FROM order_aggregations)"""

_WINDOW_SQL = ", ".join(
    f"(count(*) FILTER (WHERE order_ts >= as_of - {w}))::BIGINT AS count_{w}d, coalesce(sum(total_spend) FILTER (WHERE order_ts >= as_of - {w}), 0)::DECIMAL(28,2) AS total_spend_{w}d"
    for w in (7, 30, 90)
)


@REG.query(f"""
WITH {CURRENT_ORDERS}
SELECT customer_id, event_name, count(*) AS "count", CAST(floor((epoch_us(any_value(as_of)::TIMESTAMP) - epoch_us(max(order_ts))) / 86400000000.0) AS INTEGER) AS days_since,
       coalesce(sum(total_spend), 0)::DECIMAL(28,2) AS total_spend, {_WINDOW_SQL}
FROM cur, last WHERE customer_id IS NOT NULL AND order_ts IS NOT NULL GROUP BY customer_id, event_name""")
def p2_event_features_long(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).withColumnsRenamed({"entity": "customer_id", "kind": "event_name"})


@REG.query(f"""WITH l AS ({REG.oracles['p2_event_features_long']}) SELECT *, (sum("count") OVER w)::BIGINT AS events, count(*) OVER w AS kinds, min(days_since) OVER w AS last_days_since, (sum(total_spend) OVER w)::DECIMAL(28,2) AS spend FROM l WINDOW w AS (PARTITION BY customer_id)""")
def p2_event_features_flat(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p2_event_features with their types spread out again."""
    rows = p2_event_features(spark, d).withColumnsRenamed({"days_since": "last_days_since", "total_spend": "spend"})
    return rows.select("*", F.explode("features").alias("f")).drop("features").select("*", "f.*").drop("f").withColumnRenamed("kind", "event_name")


CURRENT_PERIODS = """cur AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY loaded_at DESC) AS k FROM period_aggregations) WHERE k = 1)"""


@REG.query(f"""
WITH {CURRENT_PERIODS},
days AS (SELECT customer_id, CAST(period_start AS DATE) AS day, coalesce(sum(total_spend), 0) AS amount FROM cur
         WHERE granularity = 'day' AND customer_id IS NOT NULL AND period_start IS NOT NULL GROUP BY ALL),
cal AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM days),
grid AS (SELECT c.customer_id, cal.day, coalesce(d.amount, 0) AS amount FROM (SELECT DISTINCT customer_id FROM days) c CROSS JOIN cal LEFT JOIN days d USING (customer_id, day)),
roll AS (SELECT customer_id, day, sum(amount) OVER (PARTITION BY customer_id ORDER BY day ROWS 6 PRECEDING)::DECIMAL(28,2) AS total_7d,
                sum(amount) OVER (PARTITION BY customer_id ORDER BY day ROWS 29 PRECEDING)::DECIMAL(28,2) AS total_30d FROM grid)
SELECT *, round(total_7d::DOUBLE / 7, 4) AS avg_7d, round(total_30d::DOUBLE / 30, 4) AS avg_30d FROM roll""")
def p3_trailing_totals(spark: SparkSession, d: str) -> DataFrame:
    cells = ("loaded_at", "granularity", "period_start", "customer_id", "total_spend")
    return trailing_totals(current_periods(table(spark, d, "period_aggregations"), cells).filter("granularity = 'day'"))
