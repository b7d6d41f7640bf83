"""Queries of single windows, parts of the fifth view, scalar functions, sinks and adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import floor_days, redact, sha256_key
from tidemark.operators import adapters as ad
from tidemark.operators import lenses as le
from tidemark.operators.cohorts import duplicates
from tidemark.operators.labels import health_summary, markdown_table
from tidemark.operators.ordered import sums_before
from tidemark.plans import audit_queries as au
from tidemark.plans import model_queries as mq
from tidemark.plans import platform_queries as pq
from tidemark.registry import Registry
from tidemark.session import scratch, table
from tidemark.sources import files, sinks
from tidemark.sources.warehouse import Catalog, guard_identifier

REG = Registry()
P, PC = au.PERIODS, f"{au.PERIODS}, {au.COHORTS}"

# ---------------------------------------------------------------- windows


@REG.query(f"WITH {P} SELECT customer_id, period_start, row_number() OVER (PARTITION BY customer_id ORDER BY period_start) - 1 AS n FROM periods")
def win_rank_active_period(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy("period_start")
    return au.periods(spark, d).select("customer_id", "period_start", (F.row_number().over(w).cast("bigint") - 1).alias("n"))


@REG.query(f"WITH {PC} SELECT DISTINCT cohort_id, period_start, dense_rank() OVER (PARTITION BY cohort_id ORDER BY period_start) - 1 AS n FROM periods JOIN assign USING (customer_id)")
def win_dense_period(spark: SparkSession, d: str) -> DataFrame:
    rows = au.periods(spark, d).join(au.assignments(spark, d), "customer_id").select("cohort_id", "period_start").distinct()
    return rows.withColumn("n", F.dense_rank().over(Window.partitionBy("cohort_id").orderBy("period_start")).cast("bigint") - 1)


@REG.query(f"WITH {PC}, f AS (SELECT cohort_id, customer_id, min(period_start) AS first FROM periods JOIN assign USING (customer_id) GROUP BY 1, 2), c AS (SELECT cohort_id, first, count(*) AS k FROM f GROUP BY 1, 2) SELECT cohort_id, first AS period_start, (sum(k) OVER (PARTITION BY cohort_id ORDER BY first))::BIGINT AS ever_active FROM c")
def win_running_distinct(spark: SparkSession, d: str) -> DataFrame:
    first = au.periods(spark, d).join(au.assignments(spark, d), "customer_id").groupBy("cohort_id", "customer_id").agg(F.min("period_start").alias("period_start"))
    run = Window.partitionBy("cohort_id").orderBy("period_start").rowsBetween(Window.unboundedPreceding, 0)
    return first.groupBy("cohort_id", "period_start").agg(F.count(F.lit(1)).alias("k")).select("cohort_id", "period_start", F.sum("k").over(run).alias("ever_active"))


@REG.query(f"WITH {P}, {au._rfm('rfm')}, v AS (SELECT total_spend, count(*) AS n FROM rfm GROUP BY 1) SELECT total_spend, n, coalesce(sum(n) OVER (ORDER BY total_spend DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS customers_above FROM v")
def win_top_share(spark: SparkSession, d: str) -> DataFrame:
    counts = au.rfm_rows(spark, d).groupBy("total_spend").agg(F.count(F.lit(1)).alias("n"))
    return sums_before(counts, "total_spend", ["n"], descending=True).select("total_spend", "n", F.col("n_before").alias("customers_above"))


@REG.query(f"WITH {PC}, {au._decomp(au._LEFT)} SELECT cohort_id, period_number, lead(cohort_id) OVER (PARTITION BY period_number ORDER BY cohort_id) AS next_cohort FROM l4")
def win_lead_cohort(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("period_number").orderBy("cohort_id")
    return au.agg_decomp(spark, d).select("cohort_id", "period_number", F.lead("cohort_id").over(w).alias("next_cohort"))


@REG.query(f"WITH {PC}, c3 AS (SELECT period_start, cohort_id, sum(total_spend)::DECIMAL(18,2) AS revenue FROM periods JOIN assign USING (customer_id) GROUP BY 1, 2) SELECT period_start, cohort_id, round(CASE WHEN sum(revenue) OVER w <> 0 THEN revenue::DOUBLE / (sum(revenue) OVER w)::DOUBLE * 100 ELSE 0 END, 4) AS pct_of_period FROM c3 WINDOW w AS (PARTITION BY period_start)")
def win_period_share(spark: SparkSession, d: str) -> DataFrame:
    return au.agg_c3(spark, d).select("period_start", "cohort_id", "pct_of_period")


@REG.query(f"WITH {P}, w AS (SELECT customer_id, period_start, row_number() OVER z AS k, lead(period_start) OVER z AS nx FROM periods WINDOW z AS (PARTITION BY customer_id ORDER BY period_start)) SELECT customer_id, date_diff('day', period_start, nx)::INTEGER AS days FROM w WHERE k = 1 AND nx IS NOT NULL")
def win_first_second(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy("period_start")
    rows = au.periods(spark, d).select("customer_id", "period_start", F.row_number().over(w).alias("k"), F.lead("period_start").over(w).alias("next"))
    return rows.filter("k = 1 and next is not null").select("customer_id", F.date_diff("next", "period_start").alias("days"))


# ---------------------------------------------------------------- the fifth view in parts

_H = f"WITH {PC}, {au._HEALTH}"


@REG.query(f"{_H} SELECT retention_rate FROM hm")
def agg_retention(spark: SparkSession, d: str) -> DataFrame:
    return au.agg_lens5(spark, d).select("retention_rate")


@REG.query(f"{_H} SELECT repeat_trend FROM hm")
def agg_trend(spark: SparkSession, d: str) -> DataFrame:
    return au.agg_lens5(spark, d).select("repeat_trend")


@REG.query(f"{_H} SELECT revenue_predictability_pct, acquisition_dependence_pct FROM hm")
def agg_rev_pred(spark: SparkSession, d: str) -> DataFrame:
    return au.agg_lens5(spark, d).select("revenue_predictability_pct", "acquisition_dependence_pct")


@REG.query(f"{_H} SELECT health_score FROM hs")
def agg_health(spark: SparkSession, d: str) -> DataFrame:
    return au.agg_lens5(spark, d).select("health_score")


@REG.query(f"WITH {PC}, {au._decomp(au._LEFT).replace('CASE WHEN spend <> 0 THEN round(margin::DOUBLE / spend::DOUBLE * 100 + sign(margin) * 1e-9, 2) ELSE 0 END::DECIMAL(18,2) AS margin_pct', '100::DECIMAL(18,2) AS margin_pct')} SELECT * FROM l4")
def agg_lens4(spark: SparkSession, d: str) -> DataFrame:
    """The left-aligned decomposition without margins."""
    return le.decomposition(au.periods(spark, d), au.assignments(spark, d), margin=False)


# ---------------------------------------------------------------- scalar functions


@REG.query("SELECT order_id, strftime(order_ts, '%Y-%m') AS month_label, concat(year(order_ts), '-Q', quarter(order_ts)) AS quarter_label, strftime(order_ts, '%Y') AS year_label, hour(order_ts)::INTEGER AS hour, (isodow(order_ts) - 1)::INTEGER AS weekday, floor((epoch_us(last_item_ts) - epoch_us(order_ts)) / 86400000000.0)::INTEGER AS days_open FROM order_aggregations")
def fn_date(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("order_ts")
    labels = [F.date_format(t, "yyyy-MM").alias("month_label"), F.concat(F.year(t), F.lit("-Q"), F.quarter(t)).alias("quarter_label"), F.date_format(t, "yyyy").alias("year_label")]
    return table(spark, d, "order_aggregations").select("order_id", *labels, F.hour(t).alias("hour"), F.weekday(t).alias("weekday"), floor_days(F.col("last_item_ts"), t).alias("days_open"))


@REG.query("SELECT c_custkey, 'user=' || c_name || ' password=***, token: ***' AS line FROM customer")
def fn_redact(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("user="), F.col("c_name"), F.lit(" password=s3cr3t"), F.col("c_custkey"), F.lit(", token: 'a b'"))
    return table(spark, d, "customer").select("c_custkey", redact(line).alias("line"))


@REG.query("SELECT c_custkey, sha256('select 1 from t|{\"k\":' || c_custkey || '}') AS key FROM customer")
def fn_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", sha256_key(F.lit("  SELECT 1\n   FROM  t "), F.to_json(F.struct(F.col("c_custkey").alias("k")))).alias("key"))


@REG.query("SELECT customer_id, count(*) AS n FROM customer_identifiers GROUP BY 1 HAVING count(*) > 1")
def distinct_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(table(spark, d, "customer_identifiers"), "customer_id")


@REG.query("SELECT order_id, total_spend FROM order_aggregations WHERE total_spend IS NOT NULL ORDER BY total_spend DESC, order_id, ingested_at LIMIT 20")
def top_k_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "order_aggregations").filter("total_spend is not null")
    return rows.orderBy(F.desc("total_spend"), "order_id", "ingested_at").limit(20).select("order_id", "total_spend")


# ---------------------------------------------------------------- adapters, sources and sinks


@REG.query('SELECT "column", nulls FROM (SELECT \'order_id\' AS "column", count(*) - count(order_id) AS nulls FROM order_aggregations UNION ALL SELECT \'customer_id\', count(*) - count(customer_id) FROM order_aggregations UNION ALL SELECT \'order_ts\', count(*) - count(order_ts) FROM order_aggregations UNION ALL SELECT \'total_spend\', count(*) - count(total_spend) FROM order_aggregations UNION ALL SELECT \'total_margin\', count(*) - count(total_margin) FROM order_aggregations UNION ALL SELECT \'total_quantity\', count(*) - count(total_quantity) FROM order_aggregations)')
def prj_tracks(spark: SparkSession, d: str) -> DataFrame:
    foreign = table(spark, d, "order_aggregations").withColumnsRenamed({"customer_id": "client", "total_spend": "amount"})
    return ad.null_counts(ad.adapt(foreign, "orders", {"client": "customer_id", "amount": "total_spend"}), "orders")


@REG.query("SELECT count(*) AS transactions, count(DISTINCT customer_id) AS customers, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM txn_lines")
def src_json_mcp(spark: SparkSession, d: str) -> DataFrame:
    """The lines written as files of one JSON array each, and read back as transactions."""
    path = scratch(spark)
    lines = table(spark, d, "txn_lines").withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    files.write_json_arrays(lines.drop("line_no", "ingested_at"), path)
    return files.transactions_summary(files.read_transactions(spark, path))


@REG.query("SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def src_async_query(spark: SparkSession, d: str) -> DataFrame:
    catalog = Catalog(spark, {"nation": f"{d}/nation.parquet"})
    run = catalog.submit("SELECT count(*) AS n FROM nation WHERE n_regionkey = :r", {"r": 1})
    return spark.createDataFrame([tuple(r) for r in catalog.result(run)], "n bigint")


@REG.query("SELECT * FROM (VALUES ('orders', true), ('a.b.c', true), ('last_update', false), ('x;y', false), ('a--b', false), ('1x', false)) t(name, ok)")
def sql_guard(spark: SparkSession, d: str) -> DataFrame:
    def ok(name: str) -> bool:
        try:
            return bool(guard_identifier(name))
        except ValueError:
            return False

    return spark.createDataFrame([(n, ok(n)) for n in ("orders", "a.b.c", "last_update", "x;y", "a--b", "1x")], "name string, ok boolean")


@REG.query(mq.REG.oracles["ml_clv"])
def snk_clv_csv(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}.csv"
    scores = mq.ml_clv(spark, d)
    sinks.write_single_csv(scores, path)
    return spark.read.schema(scores.schema).option("header", True).csv(path)


@REG.query()
def snk_drift(spark: SparkSession, d: str) -> DataFrame:
    results = pq.agg_feature_drift(spark, d).persist()
    texts = [("json", sinks.drift_json(results)), ("csv", sinks.drift_csv(results)), ("md", sinks.drift_markdown(results))]
    results.unpersist()
    return spark.createDataFrame(texts, "format string, text string")


@REG.query(f"""SELECT 'health' AS kind, concat('The customer base grades ', health_grade, ' with a score of ', health_score, '. Retention is ', retention_rate, ' %, the repeat trend ', repeat_trend, ', and ', acquisition_dependence_pct, ' % of revenue comes from the newest cohort.') AS text FROM ({au.REG.oracles['agg_lens5']})
UNION ALL SELECT 'retention', concat(retained, ' customers stayed (', retention_rate, ' %), ', churned, ' left (', churn_rate, ' %), ', new, ' are new, of whom ', reactivated, ' had bought before. Revenue changed by ', revenue_change_pct, ' %.') FROM ({au.REG.oracles['agg_lens2']})
UNION ALL SELECT 'cohorts', concat(count(*), ' cohorts. The best is ', arg_max(cohort_id, (total_revenue, cohort_id)), ' with ', max(total_revenue), ', the weakest ', arg_min(cohort_id, (total_revenue, cohort_id)), ' with ', min(total_revenue), '.') FROM ({au.REG.oracles['agg_cohort_summary']})""")
def snk_summaries(spark: SparkSession, d: str) -> DataFrame:
    health, moved = au.agg_lens5(spark, d).first().asDict(), au.agg_lens2(spark, d).first().asDict()
    cohorts = [r.asDict() for r in au.agg_cohort_summary(spark, d).collect()]
    return spark.createDataFrame([("health", health_summary(health)), ("retention", sinks.retention_summary(moved)), ("cohorts", sinks.cohort_summary(cohorts))], "kind string, text string")


@REG.query()
def snk_tables_md(spark: SparkSession, d: str) -> DataFrame:
    parts = {"lens1": au.agg_lens1(spark, d), "lens2": au.agg_lens2(spark, d), "lens4": au.agg_cohort_summary(spark, d), "lens5": au.agg_lens5(spark, d)}
    return spark.createDataFrame([(k, markdown_table(v)) for k, v in parts.items()], "view string, text string")


@REG.query("""WITH c AS (SELECT n_nationkey AS k, n_name AS n FROM nation)
SELECT 'csv' AS kind, 'n_nationkey,n_name' || chr(10) || string_agg(k || ',' || n || chr(10), '' ORDER BY k) AS text FROM c UNION ALL
SELECT 'html', '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Nations</title></head>' || chr(10) || '<body><h1>Nations</h1>' || chr(10) || '<table>' || chr(10) || '<tr><th>n_nationkey</th><th>n_name</th></tr>' || chr(10) || string_agg('<tr><td>' || k || '</td><td>' || n || '</td></tr>', chr(10) ORDER BY k) || chr(10) || '</table></body></html>' || chr(10) FROM c UNION ALL
SELECT 'json', '{' || chr(10) || '  "title": "Nations",' || chr(10) || '  "columns": [' || chr(10) || '    "n_nationkey",' || chr(10) || '    "n_name"' || chr(10) || '  ],' || chr(10) || '  "rows": [' || chr(10) || string_agg('    {' || chr(10) || '      "n_nationkey": ' || k || ',' || chr(10) || '      "n_name": "' || n || '"' || chr(10) || '    }', ',' || chr(10) ORDER BY k) || chr(10) || '  ]' || chr(10) || '}' FROM c""")
def snk_report(spark: SparkSession, d: str) -> DataFrame:
    """A table as a csv, a json and an html report."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return spark.createDataFrame([(k, sinks.report(rows, k, "Nations")) for k in ("csv", "html", "json")], "kind string, text string")
