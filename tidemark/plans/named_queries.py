"""Queries under further identifiers of the inventory: single labels, driver-side parts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import experiments as ex
from tidemark.operators import features as fs
from tidemark.operators import labels as la
from tidemark.operators import workflow as wf
from tidemark.operators.cache import ResultCache, cache_key
from tidemark.plans import audit_queries as au
from tidemark.plans import model_queries as mq
from tidemark.plans import platform_queries as pq
from tidemark.registry import Registry
from tidemark.session import scratch, table
from tidemark.sources.warehouse import Catalog, Factory
from tidemark.streaming import windows as wi

REG = Registry()

# ---------------------------------------------------------------- labels one by one

_L1 = mq._lens1_sql()


@REG.query(f"{_L1} SELECT greatest(least(100 - CASE WHEN one > 70 THEN 30 WHEN one > 50 THEN 15 ELSE 0 END - CASE WHEN t10 > 80 THEN 20 WHEN t10 > 60 THEN 10 ELSE 0 END + CASE WHEN ao > 3 THEN 10 ELSE 0 END, 100), 0)::INTEGER AS health FROM l1")
def cls_lens1_health(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens1(spark, d).select("health")


@REG.query(f"{_L1} SELECT CASE WHEN t10 > 70 THEN 'high' WHEN t10 > 50 THEN 'medium' ELSE 'low' END AS risk FROM l1")
def cls_lens1_risk(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens1(spark, d).select("risk")


@REG.query(f"SELECT recommendations FROM ({mq.REG.oracles['cls_lens1']})")
def cls_lens1_recs(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens1(spark, d).select("recommendations")


_L2 = au.REG.oracles["agg_lens2"]


@REG.query(f"SELECT CASE WHEN customer_count_change > 0 AND revenue_change_pct > 10 THEN 'strong' WHEN customer_count_change > 0 OR revenue_change_pct > 0 THEN 'moderate' ELSE 'negative' END AS momentum FROM ({_L2})")
def cls_lens2_momentum(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens2(spark, d).select("momentum")


@REG.query(f"SELECT concat_ws('; ', CASE WHEN retention_rate > 80 THEN 'high retention' END, CASE WHEN retention_rate < 50 THEN 'low retention' END, CASE WHEN churn_rate > 30 THEN 'high churn' END, CASE WHEN new * 100.0 / (retained + new) > 30 THEN 'many new customers' END, CASE WHEN revenue_change_pct > 20 THEN 'revenue growth' END, CASE WHEN revenue_change_pct < -20 THEN 'revenue decline' END) AS drivers FROM ({_L2})")
def cls_lens2_drivers(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens2(spark, d).select("drivers")


@REG.query(f"SELECT concat_ws('; ', CASE WHEN retention_rate < 60 THEN 'Improve retention' END, CASE WHEN churn_rate > 40 THEN 'Find the causes of churn' END, CASE WHEN customer_count_change < 0 THEN 'Win more customers' END, CASE WHEN revenue_change_pct < -10 THEN 'Restore revenue' END, CASE WHEN retention_rate > 70 AND customer_count_change > 0 AND revenue_change_pct > 5 THEN 'Keep the course' END) AS recommendations FROM ({_L2})")
def cls_lens2_recs(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens2(spark, d).select("recommendations")


_L3 = au.REG.oracles["agg_lens3"]


@REG.query(f"SELECT cohort_id, CASE WHEN count(*) <= 2 THEN 'early' WHEN count(*) <= 6 THEN 'growth' WHEN count(*) <= 12 THEN 'mature' WHEN arg_max(active_customers * 100.0 / cohort_size, period_number) < 10 THEN 'declining' ELSE 'mature' END AS maturity FROM ({_L3}) GROUP BY 1")
def cls_lens3_maturity(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens3(spark, d).select("cohort_id", "maturity")


@REG.query(f"SELECT cohort_id, CASE WHEN count(*) < 2 THEN 'moderate' WHEN sum(revenue_per_member) > 500 THEN 'strong' WHEN count(*) >= 3 AND arg_max(revenue_per_member, period_number) > 0.5 * arg_min(revenue_per_member, period_number) THEN 'moderate' WHEN sum(revenue_per_member) < 100 THEN 'weak' ELSE 'moderate' END AS ltv_trend FROM ({_L3}) GROUP BY 1")
def cls_lens3_ltv(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens3(spark, d).select("cohort_id", "ltv_trend")


@REG.query(f"SELECT cohort_id, recommendations FROM ({mq.REG.oracles['cls_lens3']})")
def cls_lens3_recs(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_lens3(spark, d).select("cohort_id", "recommendations")


@REG.query(f"SELECT differences FROM ({mq.REG.oracles['cls_lens4']})")
def cls_lens4_diff(spark: SparkSession, d: str) -> DataFrame:
    return la.lens4_differences(mq._lens4(spark, d))


@REG.query(f"SELECT recommendations FROM ({mq.REG.oracles['cls_lens4']})")
def cls_lens4_recs(spark: SparkSession, d: str) -> DataFrame:
    return la.lens4_recommendations(mq._lens4(spark, d))


@REG.query("SELECT event_id, CASE WHEN v >= 0.5 THEN 'high_drift' WHEN v >= 0.3 THEN 'medium_drift' WHEN v >= 0.1 THEN 'low_drift' ELSE 'no_drift' END AS status FROM (SELECT event_id, round(value / 100, 3) AS v FROM events)")
def cls_fs_drift(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dr.drift_status(F.round(F.col("value") / 100, 3)).alias("status"))


@REG.query("SELECT event_id, CASE WHEN c < 5 THEN 'none' WHEN c < 15 THEN 'low' WHEN c < 30 THEN 'medium' ELSE 'high' END AS level FROM (SELECT event_id, abs(round(value / 100, 3) - 0.5) / 0.5 * 100 AS c FROM events)")
def cls_perf_drift(spark: SparkSession, d: str) -> DataFrame:
    return mq.cls_model_drift(spark, d).select("event_id", F.col("performance").alias("level"))


@REG.query("SELECT order_id, round((epoch_us(last_item_ts) - epoch_us(first_item_ts)) / 60000000.0, 6)::DOUBLE AS minutes FROM order_aggregations")
def fs_computers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "order_aggregations").select("order_id", F.round(fs.session_minutes(F.col("first_item_ts"), F.col("last_item_ts")), 6).alias("minutes"))


# ---------------------------------------------------------------- driver-side parts


def _dag(spark: SparkSession, d: str, bad: int | None = None) -> wf.Dag:
    """A task for each region, one for each nation after its region, and a report after all; the region ``bad`` fails. Both tables are fixed."""
    dag, nations = wf.Dag(), table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    for r in table(spark, d, "region").select("r_regionkey").collect():
        fails = r[0] == bad
        dag.add(wf.Task(f"r{r[0]}", (lambda x: 1 / 0) if fails else (lambda x: 1), (), retries=1 if fails else 0))
    for n, r in nations:
        dag.add(wf.Task(f"n{n}", lambda x: 1, (f"r{r}",)))
    dag.add(wf.Task("report", lambda x: 1, tuple(f"n{n}" for n, _ in nations)))
    return dag


@REG.query("SELECT 'r' || r_regionkey AS task, 0::BIGINT AS wave FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'report', 2")
def wf_dag(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, wave in enumerate(_dag(spark, d).waves()) for t in wave], "task string, wave bigint")


@REG.query("SELECT 'r' || r_regionkey AS task, CASE WHEN r_regionkey = 2 THEN 'failed' ELSE 'succeeded' END AS state FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_regionkey = 2 THEN 'upstream_failed' ELSE 'succeeded' END FROM nation UNION ALL SELECT 'report', 'upstream_failed'")
def wf_engine(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(_dag(spark, d, bad=2).execute(sleep=lambda s: None).items()), "task string, state string")


@REG.query("SELECT n_nationkey, 2.0::DOUBLE AS fixed, 2.0::DOUBLE * n AS linear, 2.0::DOUBLE * n * n AS polynomial, least(2.0::DOUBLE * power(2, n - 1), 300)::DOUBLE AS exponential FROM (SELECT n_nationkey, n_nationkey % 12 + 1 AS n FROM nation)")
def wf_retry(spark: SparkSession, d: str) -> DataFrame:
    """The waits before a try whose number is made of each nation's key."""
    tries = [(r[0], r[0] % 12 + 1) for r in table(spark, d, "nation").select("n_nationkey").collect()]  # a fixed table
    rows = [(k, wf.delay_fixed(n, 2.0), wf.delay_linear(n, 2.0), wf.delay_polynomial(n, 2.0), wf.delay_exponential(n, 2.0, jitter=0.0)) for k, n in tries]
    return spark.createDataFrame(rows, "n_nationkey int, fixed double, linear double, polynomial double, exponential double")


@REG.query("SELECT 'hits' AS name, 1::BIGINT AS n UNION ALL SELECT 'misses', 1 UNION ALL SELECT 'rows', (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation))")
def cache_query(spark: SparkSession, d: str) -> DataFrame:
    """The same query twice, the second time from the cache."""
    cache, catalog, sql = ResultCache(threshold=0.0), Catalog(spark, {"nation": f"{d}/nation.parquet"}), "SELECT DISTINCT n_regionkey FROM nation"
    for _ in range(2):
        if (rows := cache.get(cache_key(sql))) is None:
            rows = catalog.query(sql).collect()
            cache.put(cache_key(sql), rows, took=1.0, size=len(rows))
    return spark.createDataFrame([("hits", cache.hits), ("misses", cache.misses), ("rows", len(rows))], "name string, n bigint")


@REG.query("SELECT count(*) AS n FROM nation")
def src_factory(spark: SparkSession, d: str) -> DataFrame:
    factory = Factory()
    factory.register("files", lambda folder: Catalog(spark, {"nation": f"{folder}/nation.parquet"}), ("folder",))
    return factory.create("files", {"folder": d}).query("SELECT count(*) AS n FROM nation")


@REG.query("SELECT feature_name, count(*) AS n FROM feature_values WHERE feature_name IN ('account_status', 'loyalty_tier') AND NOT (feature_name = 'account_status' AND value IS NOT NULL AND value <> 'null' AND trim(value, '\"') NOT IN ('active', 'dormant')) GROUP BY 1")
def fs_write(spark: SparkSession, d: str) -> DataFrame:
    """The written store's counts of the two features that the SQL names."""
    return fs_write_all(spark, d).filter("feature_name in ('account_status', 'loyalty_tier')")


@REG.query("SELECT feature_name, count(*) AS n FROM feature_values WHERE NOT coalesce(feature_name = 'account_status' AND value IS NOT NULL AND value <> 'null' AND trim(value, '\"') NOT IN ('active', 'dormant'), false) GROUP BY 1")
def fs_write_all(spark: SparkSession, d: str) -> DataFrame:
    """Values of every feature written to a store of their own, but for those that break a rule, and read back."""
    path = scratch(spark)
    values = table(spark, d, "feature_values")
    numbered = values.withColumn("source_id", F.col("value_id")).withColumn("value_id", F.xxhash64(*values.columns))
    fs.write_values(numbered, path, {"account_status": {"allowed": ("active", "dormant")}})
    return spark.read.parquet(path).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))


@REG.query("SELECT event_name FROM event_kinds WHERE lower(event_name) LIKE '%promo%'")
def fs_discover(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "event_kinds").withColumnRenamed("event_name", "feature_name")
    return fs.discover(kinds, "promo").select(F.col("feature_name").alias("event_name"))


@REG.query("""WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT b.event_type, round((b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) * (1 - 3 / (4.0 * (a.n + b.n) - 9)), 9)::DOUBLE AS g FROM g a, g b WHERE a.event_type = 'view' AND b.event_type <> 'view'""")
def st_hedges(spark: SparkSession, d: str) -> DataFrame:
    """The corrected effect of each kind of event against views."""
    m = ex.moments(table(spark, d, "events"), "event_type", "value")
    rows = [(k, ex.t_test(m["view"], v)["hedges_g"]) for k, v in m.items() if k not in (None, "view")]  # a handful of kinds
    return spark.createDataFrame(rows, "event_type string, g double").withColumn("g", F.round("g", 9))


@REG.query("SELECT src, dst FROM edges_ WHERE src LIKE 'n%'".replace("edges_", f"(WITH {pq._EDGES} SELECT * FROM edges)"))
def jn_edges(spark: SparkSession, d: str) -> DataFrame:
    frontier = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"))
    return pq.graph(spark, d)[1].join(frontier, "src").select("src", "dst")


@REG.query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS count FROM events GROUP BY 1")
def st_factories(spark: SparkSession, d: str) -> DataFrame:
    out = wi.tumbling(mq.stream_events(spark, d), "ts", "60 seconds", [], [F.count(F.lit(1)).alias("count")])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "count")
