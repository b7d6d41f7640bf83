"""Queries of the customer-base audit: mart, RFM, cohorts and the five views, over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cohorts as co
from tidemark.operators import lenses as le
from tidemark.operators import mart as ma
from tidemark.operators import rfm as rf
from tidemark.registry import Registry
from tidemark.session import stored_once, table

REG = Registry()

# ---------------------------------------------------------------- SQL building blocks

LINES = """lines0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no ORDER BY ingested_at DESC) AS k FROM txn_lines) WHERE k = 1),
derived AS (SELECT order_id, customer_id, line_no, event_ts AS ts, product_id, unit_cost, coalesce(quantity, 0) AS qty, coalesce(unit_price, 0)::DECIMAL(18,2) AS price,
  (coalesce(unit_price, 0)::DECIMAL(18,2) * coalesce(quantity, 0))::DECIMAL(28,4) AS line_total, ((coalesce(unit_price, 0) - coalesce(unit_cost, 0))::DECIMAL(18,2) * coalesce(quantity, 0))::DECIMAL(28,4) AS line_margin FROM lines0),
lines AS (SELECT * FROM derived WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND ts IS NOT NULL AND qty >= 0 AND price >= 0 AND line_total >= 0 AND coalesce(unit_cost, 0) >= 0)"""
ORDERS = (
    LINES
    + """,
orders_ AS (SELECT order_id, arg_min(customer_id, (line_no, customer_id)) AS customer_id, min(ts) AS order_ts, min(ts) AS first_item_ts, max(ts) AS last_item_ts, round(sum(line_total), 2)::DECIMAL(18,2) AS total_spend,
  round(sum(line_margin), 2)::DECIMAL(18,2) AS total_margin, sum(qty)::BIGINT AS total_quantity, count(DISTINCT nullif(product_id, '')) AS distinct_products FROM lines GROUP BY order_id)"""
)


def _periods(name: str, unit: str) -> str:
    step = {"month": "1 MONTH", "quarter": "3 MONTHS", "year": "1 YEAR"}[unit]
    return f"""{name} AS (SELECT '{unit}' AS granularity, customer_id, date_trunc('{unit}', order_ts)::TIMESTAMP AS period_start, (date_trunc('{unit}', order_ts) + INTERVAL {step})::TIMESTAMP AS period_end, count(*) AS total_orders,
  sum(total_spend)::DECIMAL(18,2) AS total_spend, sum(total_margin)::DECIMAL(18,2) AS total_margin, sum(total_quantity)::BIGINT AS total_quantity, max(order_ts) AS last_transaction_ts FROM orders_ GROUP BY ALL)"""


PERIODS = ORDERS + ",\n" + _periods("periods", "month")
RFM_AT = "TIMESTAMP '2024-07-15'"


def _rfm(name: str, where: str = "true", at: str = RFM_AT) -> str:
    return f"""{name} AS (SELECT customer_id, CAST(floor((epoch_us({at}) - epoch_us(coalesce(max(last_transaction_ts), max(period_end)))) / 86400000000.0) AS INTEGER) AS recency_days, sum(total_orders)::BIGINT AS frequency,
  round((sum(total_spend)::DECIMAL(18,2))::DOUBLE / sum(total_orders) + 1e-9, 2)::DECIMAL(18,2) AS monetary, sum(total_spend)::DECIMAL(18,2) AS total_spend, min(period_start) AS observation_start, {at} AS observation_end FROM periods WHERE {where} GROUP BY customer_id)"""


COHORTS = """contract AS (SELECT customer_id, min(acquisition_ts) AS acquisition_ts FROM customer_identifiers WHERE customer_id IS NOT NULL GROUP BY 1),
assign AS (SELECT customer_id, arg_min(cohort_id, (start_date, cohort_id)) AS cohort_id FROM contract JOIN cohort_definitions ON acquisition_ts >= start_date AND acquisition_ts < end_date GROUP BY 1)"""

# ---------------------------------------------------------------- DataFrame building blocks


def lines(spark: SparkSession, d: str) -> DataFrame:
    return ma.valid_lines(ma.current_lines(table(spark, d, "txn_lines")))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """The mart's orders, which are made once from the lines as they are."""
    return stored_once(spark, "orders", f"{d}/txn_lines.parquet", lambda: ma.aggregate_orders(lines(spark, d)))


def periods(spark: SparkSession, d: str) -> DataFrame:
    """The mart's months by customer, from its orders."""
    return stored_once(spark, "months", f"{d}/txn_lines.parquet", lambda: ma.aggregate_periods(orders(spark, d)))


def at() -> Column:
    """The end of the observation."""
    return F.lit("2024-07-15").cast("timestamp_ntz")


SPLIT = "period_start < TIMESTAMP_NTZ'2023-10-01'"
FIRST, SECOND = "period_start >= TIMESTAMP '2023-07-01' AND period_start < TIMESTAMP '2023-10-01'", "period_start >= TIMESTAMP '2023-10-01' AND period_start < TIMESTAMP '2024-01-01'"
HISTORY = "period_start < TIMESTAMP '2023-10-01'"


def rfm_rows(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    p = periods(spark, d)
    return rf.rfm(p.filter(where.replace("TIMESTAMP '", "TIMESTAMP_NTZ'")) if where else p, at())


def assignments(spark: SparkSession, d: str) -> DataFrame:
    return co.assign_cohorts(co.merge_identifiers(table(spark, d, "customer_identifiers")), table(spark, d, "cohort_definitions"))


# ---------------------------------------------------------------- mart


@REG.query(f"WITH {LINES} SELECT order_id, line_no, qty, price, line_total, line_margin FROM derived")
def prj_line_derive(spark: SparkSession, d: str) -> DataFrame:
    return ma.derive_lines(ma.current_lines(table(spark, d, "txn_lines"))).select("order_id", "line_no", "qty", "price", "line_total", "line_margin")


@REG.query(f"""WITH {LINES} SELECT violation, count(*) AS n FROM (SELECT unnest([CASE WHEN order_id IS NULL THEN 'order_id missing' END, CASE WHEN customer_id IS NULL THEN 'customer_id missing' END, CASE WHEN ts IS NULL THEN 'time missing' END,
 CASE WHEN qty < 0 THEN 'negative quantity' END, CASE WHEN price < 0 THEN 'negative price' END, CASE WHEN line_total < 0 THEN 'negative total' END, CASE WHEN unit_cost < 0 THEN 'negative cost' END]) AS violation FROM derived) WHERE violation IS NOT NULL GROUP BY 1""")
def flt_line_validate(spark: SparkSession, d: str) -> DataFrame:
    derived = ma.derive_lines(ma.current_lines(table(spark, d, "txn_lines")))
    return derived.select(F.explode(ma.violations(derived)).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@REG.query(f"WITH {ORDERS} SELECT * FROM orders_")
def agg_orders(spark: SparkSession, d: str) -> DataFrame:
    return ma.aggregate_orders(lines(spark, d))


@REG.query(f"WITH {ORDERS}, {_periods('pm', 'month')}, {_periods('pq', 'quarter')}, {_periods('py', 'year')} SELECT * FROM pm UNION ALL SELECT * FROM pq UNION ALL SELECT * FROM py")
def agg_periods(spark: SparkSession, d: str) -> DataFrame:
    return ma.aggregate_periods(ma.aggregate_orders(lines(spark, d)), ma.GRANULARITIES)


@REG.query("SELECT order_id, date_trunc('month', order_ts)::TIMESTAMP AS month_start, date_trunc('quarter', order_ts)::TIMESTAMP AS quarter_start, date_trunc('year', order_ts)::TIMESTAMP AS year_start, (date_trunc('month', order_ts) + INTERVAL 1 MONTH)::TIMESTAMP AS month_end, (date_trunc('quarter', order_ts) + INTERVAL 3 MONTHS)::TIMESTAMP AS quarter_end, (date_trunc('year', order_ts) + INTERVAL 1 YEAR)::TIMESTAMP AS year_end FROM order_aggregations")
def fn_period(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("order_ts")
    return table(spark, d, "order_aggregations").select("order_id", *[ma.period_start(ts, g).alias(f"{g}_start") for g in ma.GRANULARITIES], *[ma.period_end(ma.period_start(ts, g), g).alias(f"{g}_end") for g in ma.GRANULARITIES])


@REG.query("SELECT count(*) AS n, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM txn_lines WHERE event_ts <= TIMESTAMP '2023-12-31'")
def flt_max_txn_date(spark: SparkSession, d: str) -> DataFrame:
    return ma.until(table(spark, d, "txn_lines"), F.lit("2023-12-31").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


@REG.query(f"WITH {PERIODS} SELECT (SELECT count(*) FROM orders_) AS order_count, count(*) AS period_count, count(DISTINCT customer_id) AS customer_count, min(period_start) AS first_period, max(period_start) AS last_period FROM periods")
def agg_mart_summary(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    return ma.mart_summary(o, ma.aggregate_periods(o))


def _json_sql(kind: str, columns: dict[str, str], source: str) -> str:
    """A row of JSON for each row: texts and times in quotes, numbers as they are, nulls left out."""
    iso = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
    cells = ", ".join(f"'\"{c}\":' || " + (f"to_json({c})::VARCHAR" if t == "text" else f"'\"' || {iso.format(c)} || '\"'" if t == "time" else f"{c}::VARCHAR") for c, t in columns.items())
    return f"SELECT {kind} AS kind, '{{' || concat_ws(',', {cells}) || '}}' AS json FROM {source}"


_ORDER_CELLS = {"order_id": "text", "customer_id": "text", "order_ts": "time", "first_item_ts": "time", "last_item_ts": "time", "total_spend": "", "total_margin": "", "total_quantity": "", "distinct_products": ""}
_PERIOD_CELLS = {"customer_id": "text", "period_start": "time", "period_end": "time", "total_orders": "", "total_spend": "", "total_margin": "", "total_quantity": "", "last_transaction_ts": "time"}


@REG.query(f"WITH {ORDERS}, {_periods('pm', 'month')}, {_periods('pq', 'quarter')}, {_periods('py', 'year')}, p AS (SELECT * FROM pm UNION ALL SELECT * FROM pq UNION ALL SELECT * FROM py) {_json_sql(chr(39) + 'orders' + chr(39), _ORDER_CELLS, 'orders_')} UNION ALL {_json_sql(chr(39) + 'periods_' + chr(39) + ' || granularity', _PERIOD_CELLS, 'p')}")
def snk_mart_json(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    return ma.mart_json(o, ma.aggregate_periods(o, ma.GRANULARITIES))


@REG.query(f"WITH {PERIODS} SELECT * FROM periods WHERE period_start >= TIMESTAMP '2023-04-01' AND period_start < TIMESTAMP '2023-07-01'")
def flt_period_window(spark: SparkSession, d: str) -> DataFrame:
    return periods(spark, d).filter("period_start >= TIMESTAMP_NTZ'2023-04-01' AND period_start < TIMESTAMP_NTZ'2023-07-01'")


# ---------------------------------------------------------------- RFM


@REG.query(f"WITH {PERIODS}, {_rfm('rfm')} SELECT * FROM rfm")
def agg_rfm(spark: SparkSession, d: str) -> DataFrame:
    return rfm_rows(spark, d)


def _bin_sql(s: str, c: str) -> str:
    quantiles = " ".join(f"WHEN {q} THEN quantile_cont({c}::DOUBLE, [{', '.join(repr(k / q) for k in range(q + 1))}])" for q in range(2, 6))
    return f"e{s} AS (SELECT count(DISTINCT {c}) AS n, list_sort(list_distinct(CASE least(count(DISTINCT {c}), 5) {quantiles} END)) AS e FROM rfm)"


SCORED = f"""{_rfm('rfm')}, {_bin_sql('r', 'recency_days')}, {_bin_sql('f', 'frequency')}, {_bin_sql('m', 'monetary')},
binned AS (SELECT rfm.*, {", ".join(f"CASE WHEN e{s}.n > 1 THEN greatest(len(list_filter(e{s}.e, lambda x: x < {c}::DOUBLE)) - 1, 0) END AS b_{s}" for s, c in (('r', 'recency_days'), ('f', 'frequency'), ('m', 'monetary')))} FROM rfm, er, ef, em),
scored AS (SELECT * EXCLUDE (b_r, b_f, b_m), coalesce((SELECT max(b_r) FROM binned) - b_r + 1, 3)::INTEGER AS r_score, coalesce(b_f + 1, 3)::INTEGER AS f_score, coalesce(b_m + 1, 3)::INTEGER AS m_score FROM binned)"""


@REG.query(f"WITH {PERIODS}, {SCORED} SELECT *, concat(r_score, f_score, m_score) AS rfm_score FROM scored")
def agg_rfm_score(spark: SparkSession, d: str) -> DataFrame:
    return rf.rfm_scores(rfm_rows(spark, d))


@REG.query(f"WITH {PERIODS}, {SCORED} SELECT concat(r_score, f_score, m_score) AS rfm_score, count(*) AS customers FROM scored GROUP BY 1")
def agg_rfm_dist(spark: SparkSession, d: str) -> DataFrame:
    return rf.score_distribution(rf.rfm_scores(rfm_rows(spark, d)))


@REG.query(f"WITH {PERIODS}, {_rfm('a', FIRST)}, {_rfm('b', SECOND)} SELECT 'rfm_metrics' AS key, * FROM a UNION ALL SELECT 'rfm_metrics_period2', * FROM b")
def agg_rfm_two_periods(spark: SparkSession, d: str) -> DataFrame:
    return rfm_rows(spark, d, FIRST).withColumn("key", F.lit("rfm_metrics")).unionByName(rfm_rows(spark, d, SECOND).withColumn("key", F.lit("rfm_metrics_period2")))


# ---------------------------------------------------------------- lenses 1 and 2

_PARETO = """ranked AS (SELECT total_spend AS v, row_number() OVER (ORDER BY total_spend DESC) AS rn, count(*) OVER () AS n FROM rfm),
share AS (SELECT p AS percent, CASE WHEN (SELECT sum(total_spend) FROM rfm) <> 0 THEN round(sum(v) FILTER (WHERE rn <= greatest(n * p // 100, 1))::DOUBLE / (SELECT sum(total_spend) FROM rfm)::DOUBLE * 100 + 1e-9, 2) ELSE 0 END::DECIMAL(18,2) AS revenue_share FROM ranked, (SELECT unnest([10, 20]) AS p) GROUP BY p)"""


@REG.query(f"WITH {PERIODS}, {_rfm('rfm')}, {_PARETO} SELECT percent, revenue_share FROM share")
def agg_pareto(spark: SparkSession, d: str) -> DataFrame:
    return le.pareto(rfm_rows(spark, d))


@REG.query(f"""WITH {PERIODS}, {_rfm('rfm')}, {_PARETO} SELECT count(*) AS total_customers, count(*) FILTER (WHERE frequency = 1) AS one_time_buyers, round((count(*) FILTER (WHERE frequency = 1))::DOUBLE / count(*) * 100 + 1e-9, 2)::DECIMAL(18,2) AS one_time_buyer_pct, sum(frequency)::BIGINT AS total_orders,
 sum(total_spend)::DECIMAL(18,2) AS total_revenue, round(sum(frequency)::DOUBLE / count(*) + 1e-9, 2)::DECIMAL(18,2) AS avg_orders_per_customer, round(quantile_cont(total_spend::DOUBLE, 0.5) + 1e-9, 2)::DECIMAL(18,2) AS median_customer_value,
 (SELECT revenue_share FROM share WHERE percent = 10) AS top_10pct_revenue_share, (SELECT revenue_share FROM share WHERE percent = 20) AS top_20pct_revenue_share FROM rfm""")
def agg_lens1(spark: SparkSession, d: str) -> DataFrame:
    return le.lens1(rfm_rows(spark, d))


_MIGRATION = f"""{_rfm('a', FIRST)}, {_rfm('b', SECOND)}, {_rfm('h', HISTORY)},
moved AS (SELECT customer_id, CASE WHEN a.customer_id IS NOT NULL AND b.customer_id IS NOT NULL THEN 'retained' WHEN a.customer_id IS NOT NULL THEN 'churned' ELSE 'new' END AS status FROM a FULL JOIN b USING (customer_id)),
status_ AS (SELECT * FROM moved UNION ALL SELECT customer_id, 'reactivated' FROM moved WHERE status = 'new' AND customer_id IN (SELECT customer_id FROM h))"""


@REG.query(f"WITH {PERIODS}, {_MIGRATION} SELECT * FROM status_")
def agg_lens2_status(spark: SparkSession, d: str) -> DataFrame:
    return le.migration(rfm_rows(spark, d, FIRST), rfm_rows(spark, d, SECOND), rfm_rows(spark, d, HISTORY))


@REG.query(f"WITH {PERIODS}, {_MIGRATION} SELECT * FROM moved")
def jn_migration(spark: SparkSession, d: str) -> DataFrame:
    return le.migration(rfm_rows(spark, d, FIRST), rfm_rows(spark, d, SECOND))


def _pct_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN round({a}::DOUBLE / {b} * 100 + 1e-9, 2) ELSE 0 END::DECIMAL(18,2)"


def _change_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> 0 THEN round(({b} - {a})::DOUBLE / {a}::DOUBLE * 100, 2) WHEN {b} > 0 THEN 100 ELSE 0 END::DECIMAL(18,2)"


@REG.query(f"""WITH {PERIODS}, {_MIGRATION}, s AS (SELECT count(*) FILTER (WHERE status = 'retained') AS retained, count(*) FILTER (WHERE status = 'churned') AS churned, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'reactivated') AS reactivated FROM status_),
x AS (SELECT count(*) AS c1, sum(total_spend) AS r1, sum(frequency) AS o1 FROM a), y AS (SELECT count(*) AS c2, sum(total_spend) AS r2, sum(frequency) AS o2 FROM b)
SELECT retained, churned, new, reactivated, {_pct_sql('retained', 'c1')} AS retention_rate, {_pct_sql('churned', 'c1')} AS churn_rate, {_pct_sql('reactivated', 'c2')} AS reactivation_rate, c2 - c1 AS customer_count_change, {_change_sql('r1', 'r2')} AS revenue_change_pct, {_change_sql('(r1::DOUBLE / o1)', '(r2::DOUBLE / o2)')} AS aov_change_pct FROM s, x, y""")
def agg_lens2(spark: SparkSession, d: str) -> DataFrame:
    return le.lens2(rfm_rows(spark, d, FIRST), rfm_rows(spark, d, SECOND), rfm_rows(spark, d, HISTORY))


@REG.query(f"WITH {PERIODS}, {_rfm('a', FIRST)}, {_rfm('b', SECOND)} SELECT 'both' AS part, count(*) AS n FROM (SELECT customer_id FROM a INTERSECT SELECT customer_id FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT customer_id FROM a EXCEPT SELECT customer_id FROM b) UNION ALL SELECT 'second only', count(*) FROM (SELECT customer_id FROM b EXCEPT SELECT customer_id FROM a)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = (rfm_rows(spark, d, w).select("customer_id") for w in (FIRST, SECOND))
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n("both", a.intersect(b)).union(n("first only", a.subtract(b))).union(n("second only", b.subtract(a)))


@REG.query(f"WITH {PERIODS}, {_rfm('a', FIRST)}, {_rfm('h', HISTORY)} SELECT customer_id FROM a WHERE customer_id NOT IN (SELECT customer_id FROM h)")
def set_subset(spark: SparkSession, d: str) -> DataFrame:
    return le.history_gaps(rfm_rows(spark, d, FIRST), rfm_rows(spark, d, HISTORY))


# ---------------------------------------------------------------- cohorts


@REG.query("""SELECT customer_id, violation FROM (SELECT customer_id, unnest([CASE WHEN customer_id IS NULL OR customer_id = '' THEN 'customer_id missing' END, CASE WHEN acquisition_ts IS NULL THEN 'acquisition_ts missing' END, CASE WHEN source_system IS NULL OR source_system = '' THEN 'source_system missing' END,
 CASE WHEN acquisition_ts < TIMESTAMP '1970-01-01' THEN 'acquisition_ts before 1970' END, CASE WHEN acquisition_ts > TIMESTAMP '2024-01-01' THEN 'acquisition_ts in the future' END, CASE WHEN NOT coalesce(is_visible, true) THEN 'not visible' END]) AS violation FROM customer_identifiers) WHERE violation IS NOT NULL""")
def flt_contract(spark: SparkSession, d: str) -> DataFrame:
    return co.contract_violations(table(spark, d, "customer_identifiers"), F.lit("2024-01-01").cast("timestamp_ntz"))


@REG.query("""SELECT customer_id, min(acquisition_ts) AS acquisition_ts, arg_min(coalesce(source_system, '∅'), (acquisition_ts IS NULL, coalesce(acquisition_ts, TIMESTAMP '1970-01-01'), coalesce(source_system, ''))) AS source_system, bool_or(coalesce(is_visible, true)) AS is_visible FROM customer_identifiers WHERE customer_id IS NOT NULL GROUP BY 1""")
def agg_merge_ids(spark: SparkSession, d: str) -> DataFrame:
    return co.merge_identifiers(table(spark, d, "customer_identifiers")).select("customer_id", "acquisition_ts", F.coalesce("source_system", F.lit("∅")).alias("source_system"), "is_visible")


@REG.query()
def agg_merge_ids_metadata(spark: SparkSession, d: str) -> DataFrame:
    return co.merge_identifiers(table(spark, d, "customer_identifiers"))


@REG.query(f"WITH {COHORTS} SELECT * FROM assign")
def jn_cohort_range(spark: SparkSession, d: str) -> DataFrame:
    return assignments(spark, d)


@REG.query(f"WITH {COHORTS} SELECT count(*) AS customers, count(cohort_id) AS assigned, count(*) - count(cohort_id) AS unassigned FROM contract LEFT JOIN assign USING (customer_id)")
def agg_coverage(spark: SparkSession, d: str) -> DataFrame:
    return co.coverage(co.merge_identifiers(table(spark, d, "customer_identifiers")), assignments(spark, d))


@REG.query("SELECT cohort_id, next_id FROM (SELECT cohort_id, end_date, lead(cohort_id) OVER w AS next_id, lead(start_date) OVER w AS next_start FROM cohort_definitions WINDOW w AS (ORDER BY start_date, cohort_id)) WHERE next_start < end_date")
def win_overlap(spark: SparkSession, d: str) -> DataFrame:
    return co.overlaps(table(spark, d, "cohort_definitions"))


def _generated(kind: str) -> str:
    step = {"month": "1 MONTH", "quarter": "3 MONTHS", "year": "1 YEAR"}[kind]
    label = {"month": "strftime(p, '%Y-%m')", "quarter": "concat(year(p), '-Q', quarter(p))", "year": "strftime(p, '%Y')"}[kind]
    return f"SELECT {label} AS cohort_id, greatest(p, low)::TIMESTAMP AS start_date, (p + INTERVAL {step})::TIMESTAMP AS end_date FROM (SELECT low, unnest(generate_series(date_trunc('{kind}', low)::TIMESTAMP, date_trunc('{kind}', high)::TIMESTAMP, INTERVAL {step})) AS p FROM (SELECT min(acquisition_ts) AS low, max(acquisition_ts) AS high FROM customer_identifiers))"


def _cohorts_of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    bounds = table(spark, d, "customer_identifiers").agg(F.min("acquisition_ts").alias("lo"), F.max("acquisition_ts").alias("hi"))
    return co.generate_cohorts(F.col("lo"), F.col("hi"), bounds, kind)


for _kind in co.KINDS:
    REG.query(_generated(_kind), name=f"fn_cohorts_{_kind}")(lambda spark, d, kind=_kind: _cohorts_of(spark, d, kind))


@REG.query(f"WITH {PERIODS}, {COHORTS} SELECT p.* FROM periods p WHERE customer_id IN (SELECT customer_id FROM assign WHERE cohort_id = '2023-Q1')")
def jn_cohort_members(spark: SparkSession, d: str) -> DataFrame:
    return periods(spark, d).join(assignments(spark, d).filter("cohort_id = '2023-Q1'"), "customer_id", "left_semi")


@REG.query(f"WITH {PERIODS}, {COHORTS} SELECT customer_id, cohort_id, period_start, total_orders FROM periods JOIN assign USING (customer_id)")
def jn_assign_inner(spark: SparkSession, d: str) -> DataFrame:
    return periods(spark, d).join(assignments(spark, d), "customer_id").select("customer_id", "cohort_id", "period_start", "total_orders")


@REG.query(f"WITH {PERIODS}, {COHORTS} SELECT customer_id, any_value(cohort_id) AS cohort_id, coalesce(sum(total_orders), 0)::BIGINT AS orders FROM assign LEFT JOIN periods USING (customer_id) GROUP BY 1")
def jn_assign_left(spark: SparkSession, d: str) -> DataFrame:
    n = periods(spark, d).groupBy("customer_id").agg(F.sum("total_orders").alias("orders"))
    return assignments(spark, d).join(n, "customer_id", "left").select("customer_id", "cohort_id", F.coalesce("orders", F.lit(0)).alias("orders"))


# ---------------------------------------------------------------- lens 3

_LENS3 = """size AS (SELECT cohort_id, count(DISTINCT customer_id) AS cohort_size FROM assign GROUP BY 1),
l3r AS (SELECT p.*, cohort_id, row_number() OVER (PARTITION BY cohort_id, customer_id ORDER BY period_start) AS k FROM periods p JOIN assign USING (customer_id) JOIN cohort_definitions USING (cohort_id) WHERE period_start >= start_date),
l3p AS (SELECT cohort_id, period_start, count(DISTINCT customer_id) AS active_customers, count(*) FILTER (WHERE k = 1) AS newly, sum(total_orders) AS orders, sum(total_spend) AS revenue FROM l3r GROUP BY 1, 2),
l3 AS (SELECT cohort_id, dense_rank() OVER w - 1 AS period_number, period_start, active_customers, cohort_size, round((sum(newly) OVER w)::DOUBLE / cohort_size, 6) AS cumulative_activation_rate, round(orders::DOUBLE / active_customers, 6) AS orders_per_active, round(orders::DOUBLE / cohort_size, 6) AS orders_per_member,
 round(revenue::DOUBLE / active_customers, 6) AS revenue_per_active, round(revenue::DOUBLE / cohort_size, 6) AS revenue_per_member, revenue::DECIMAL(18,2) AS total_revenue FROM l3p JOIN size USING (cohort_id) WINDOW w AS (PARTITION BY cohort_id ORDER BY period_start))"""


def _lens3_rows(spark: SparkSession, d: str) -> DataFrame:
    return le.lens3(periods(spark, d), assignments(spark, d), table(spark, d, "cohort_definitions"))


@REG.query(f"WITH {PERIODS}, {COHORTS}, {_LENS3} SELECT * FROM l3")
def agg_lens3(spark: SparkSession, d: str) -> DataFrame:
    return _lens3_rows(spark, d)


@REG.query(f"WITH {PERIODS}, {COHORTS}, {_LENS3} SELECT cohort_id, period_number, cumulative_activation_rate FROM l3")
def agg_activation_curve(spark: SparkSession, d: str) -> DataFrame:
    return le.activation_curve(_lens3_rows(spark, d))


# ---------------------------------------------------------------- lens 4


def _decomp(index: str) -> str:
    return f"""size AS (SELECT cohort_id, count(DISTINCT customer_id) AS cohort_size FROM assign GROUP BY 1),
l4r AS (SELECT p.*, cohort_id, {index} AS period_number FROM periods p JOIN assign USING (customer_id)),
l4s AS (SELECT cohort_id, period_number, count(*) AS active_customers, sum(total_orders) AS orders, sum(total_spend) AS spend, sum(total_margin) AS margin FROM l4r GROUP BY 1, 2),
l4f AS (SELECT cohort_id, period_number, cohort_size, active_customers, {_pct_sql('active_customers', 'cohort_size')} AS pct_active, CASE WHEN active_customers <> 0 THEN round(orders::DOUBLE / active_customers + 1e-9, 2) ELSE 0 END::DECIMAL(18,2) AS aof,
 CASE WHEN orders <> 0 THEN round(spend::DOUBLE / orders + 1e-9, 2) ELSE 0 END::DECIMAL(18,2) AS aov, CASE WHEN spend <> 0 THEN round(margin::DOUBLE / spend::DOUBLE * 100 + sign(margin) * 1e-9, 2) ELSE 0 END::DECIMAL(18,2) AS margin_pct FROM l4s JOIN size USING (cohort_id)),
l4 AS (SELECT *, round((cohort_size::DECIMAL(38,0) * pct_active::DECIMAL(38,2) * aof::DECIMAL(38,2) * aov::DECIMAL(38,2) * margin_pct::DECIMAL(38,2) * 0.0001::DECIMAL(4,4))::DECIMAL(38,6), 2)::DECIMAL(18,2) AS total_revenue FROM l4f)"""


_LEFT = "row_number() OVER (PARTITION BY customer_id ORDER BY period_start) - 1"
_TIME = "(SELECT count(DISTINCT q.period_start) FROM periods q WHERE q.period_start < p.period_start)"


@REG.query(f"WITH {PERIODS}, {COHORTS}, {_decomp(_LEFT)} SELECT * FROM l4")
def agg_decomp(spark: SparkSession, d: str) -> DataFrame:
    return le.decomposition(periods(spark, d), assignments(spark, d))


@REG.query(f"WITH {PERIODS}, {COHORTS}, {_decomp(_TIME)} SELECT * FROM l4")
def agg_lens4_time_aligned(spark: SparkSession, d: str) -> DataFrame:
    return le.decomposition(periods(spark, d), assignments(spark, d), aligned="time")


def _delta(m: str) -> str:
    return f"({m}_b - {m})::DECIMAL(18,6) AS {m}_delta, {_change_sql(m, m + '_b')} AS {m}_change_pct"


_PAIR_COLUMNS = ("pct_active", "aof", "aov", "revenue")


@REG.query(f"""WITH {PERIODS}, {COHORTS}, {_decomp(_LEFT)}, v AS (SELECT *, round(total_revenue::DOUBLE / cohort_size + sign(total_revenue) * 1e-10, 6)::DECIMAL(28,6) AS revenue FROM l4),
pairs AS (SELECT *, lead(cohort_id) OVER w AS cohort_b, {", ".join(f"lead({m}) OVER w AS {m}_b" for m in _PAIR_COLUMNS)} FROM v WINDOW w AS (PARTITION BY period_number ORDER BY cohort_id))
SELECT cohort_id AS cohort_a, cohort_b, period_number, {", ".join(_delta(m) for m in _PAIR_COLUMNS)} FROM pairs WHERE cohort_b IS NOT NULL""")
def agg_cohort_pair(spark: SparkSession, d: str) -> DataFrame:
    return le.compare_cohorts(le.decomposition(periods(spark, d), assignments(spark, d)))


@REG.query(f"""WITH {PERIODS}, {COHORTS}, {_decomp(_LEFT)} SELECT cohort_id, sum(total_revenue)::DECIMAL(18,2) AS total_revenue, round(avg(total_revenue::DOUBLE), 2) AS avg_revenue, count(*) AS periods, arg_max(period_number, (total_revenue, -period_number)) AS best_period FROM l4 GROUP BY 1""")
def agg_cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    return le.cohort_totals(le.decomposition(periods(spark, d), assignments(spark, d)))


@REG.query(f"""WITH {PERIODS}, {COHORTS}, size AS (SELECT cohort_id, count(DISTINCT customer_id) AS cohort_size FROM assign GROUP BY 1),
w AS (SELECT cohort_id, customer_id, period_start, row_number() OVER z AS k, lead(period_start) OVER z AS nx FROM periods JOIN assign USING (customer_id) WINDOW z AS (PARTITION BY cohort_id, customer_id ORDER BY period_start)),
g AS (SELECT cohort_id, count(*) AS rc, median(date_diff('day', period_start, nx)) AS med, avg(date_diff('day', period_start, nx)) AS mn FROM w WHERE k = 1 AND nx IS NOT NULL GROUP BY 1)
SELECT cohort_id, cohort_size, coalesce(rc, 0) AS repeat_customers, {_pct_sql('coalesce(rc, 0)', 'cohort_size')} AS repeat_rate, round(med, 2) AS median_days, round(mn, 2) AS mean_days FROM size LEFT JOIN g USING (cohort_id)""")
def agg_ttsp(spark: SparkSession, d: str) -> DataFrame:
    return le.time_to_second(periods(spark, d), assignments(spark, d))


@REG.query(f"""WITH {PERIODS}, {COHORTS}, size AS (SELECT cohort_id, count(DISTINCT customer_id) AS cohort_size FROM assign GROUP BY 1),
n AS (SELECT cohort_id, customer_id, count(*) AS n FROM periods JOIN assign USING (customer_id) GROUP BY 1, 2), ks AS (SELECT cohort_id, unnest(generate_series(0, max(n) - 1)) AS k FROM n GROUP BY cohort_id)
SELECT cohort_id, k::INTEGER AS k, {_pct_sql('count(*) FILTER (WHERE n > k + 1)', 'any_value(cohort_size)')} AS rate FROM ks JOIN n USING (cohort_id) JOIN size USING (cohort_id) GROUP BY 1, 2""")
def agg_cumulative_repeat(spark: SparkSession, d: str) -> DataFrame:
    return le.cumulative_repeat(periods(spark, d), assignments(spark, d))


# ---------------------------------------------------------------- lens 5


@REG.query(f"""WITH {PERIODS}, {COHORTS}, c3 AS (SELECT period_start, cohort_id, sum(total_spend)::DECIMAL(18,2) AS revenue, count(DISTINCT customer_id) AS active_customers FROM periods JOIN assign USING (customer_id) GROUP BY 1, 2)
SELECT period_start, cohort_id, revenue, round(CASE WHEN sum(revenue) OVER w <> 0 THEN revenue::DOUBLE / (sum(revenue) OVER w)::DOUBLE * 100 ELSE 0 END, 4) AS pct_of_period, active_customers, round(revenue::DOUBLE / active_customers, 4) AS revenue_per_active FROM c3 WINDOW w AS (PARTITION BY period_start)""")
def agg_c3(spark: SparkSession, d: str) -> DataFrame:
    return le.revenue_by_cohort(periods(spark, d), assignments(spark, d))


_REPEAT = f"""o AS (SELECT customer_id, any_value(cohort_id) AS cohort_id, coalesce(sum(total_orders), 0) AS orders FROM assign LEFT JOIN periods USING (customer_id) GROUP BY 1),
rep AS (SELECT cohort_id, count(*) FILTER (WHERE orders > 0) AS cohort_size, count(*) FILTER (WHERE orders = 1) AS one_time_buyers, count(*) FILTER (WHERE orders > 1) AS repeat_buyers, {_pct_sql('count(*) FILTER (WHERE orders > 1)', 'count(*) FILTER (WHERE orders > 0)')} AS repeat_rate,
 round(sum(orders)::DOUBLE / nullif(count(*) FILTER (WHERE orders > 0), 0), 4) AS avg_orders FROM o GROUP BY 1)"""


@REG.query(f"WITH {PERIODS}, {COHORTS}, {_REPEAT} SELECT * FROM rep")
def agg_repeat(spark: SparkSession, d: str) -> DataFrame:
    return le.repeat_behaviour(periods(spark, d), assignments(spark, d))


_HEALTH = f"""{_REPEAT}, e AS (SELECT max(cohort_id) AS newest, min(cohort_id) AS oldest, count(DISTINCT customer_id) AS assigned FROM assign),
ac AS (SELECT count(DISTINCT customer_id) AS active FROM periods WHERE customer_id IN (SELECT customer_id FROM assign)),
rv AS (SELECT sum(total_spend) AS total, sum(total_spend) FILTER (WHERE cohort_id = (SELECT newest FROM e)) AS nw FROM periods JOIN assign USING (customer_id)),
rt AS (SELECT max(repeat_rate) FILTER (WHERE cohort_id = (SELECT newest FROM e)) AS nr, max(repeat_rate) FILTER (WHERE cohort_id = (SELECT oldest FROM e)) AS orr, count(*) AS cohorts FROM rep),
hm AS (SELECT {_pct_sql('active', 'assigned')} AS retention_rate, CASE WHEN cohorts < 2 THEN 'stable' WHEN orr = 0 THEN CASE WHEN nr > 0 THEN 'improving' ELSE 'stable' END WHEN nr::DOUBLE / orr >= 1.1 THEN 'improving' WHEN nr::DOUBLE / orr <= 0.9 THEN 'declining' ELSE 'stable' END AS repeat_trend,
 (CASE WHEN total <> 0 THEN 100 - {_pct_sql('nw', 'total')} ELSE 0 END)::DECIMAL(18,2) AS revenue_predictability_pct, {_pct_sql('nw', 'total')} AS acquisition_dependence_pct FROM e, ac, rv, rt),
hs AS (SELECT *, round(0.30 * retention_rate + 0.30 * CASE repeat_trend WHEN 'improving' THEN 80 WHEN 'stable' THEN 50 ELSE 20 END + 0.20 * revenue_predictability_pct + 0.20 * (100 - acquisition_dependence_pct), 2)::DECIMAL(18,2) AS health_score FROM hm)"""


@REG.query(f"WITH {PERIODS}, {COHORTS}, {_HEALTH} SELECT *, CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 80 THEN 'B' WHEN health_score >= 70 THEN 'C' WHEN health_score >= 60 THEN 'D' ELSE 'F' END AS health_grade FROM hs")
def agg_lens5(spark: SparkSession, d: str) -> DataFrame:
    return le.health(periods(spark, d), assignments(spark, d))
