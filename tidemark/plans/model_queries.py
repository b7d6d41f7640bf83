"""Queries of models, event windows, labels, charts and synthetic data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rows import attach
from tidemark.operators import labels as la
from tidemark.operators import lenses as le
from tidemark.operators import models as mo
from tidemark.plans import audit_queries as au
from tidemark.registry import Registry
from tidemark.session import checkpointed, scratch, stored, table
from tidemark.sources import files
from tidemark.sources import synthetic as sy
from tidemark.streaming import events as ev
from tidemark.streaming import windows as wi

REG = Registry()

# ---------------------------------------------------------------- models

_BG = f"""bg AS (SELECT customer_id, greatest(sum(total_orders) - 1, 0)::BIGINT AS frequency, CASE WHEN sum(total_orders) > 1 THEN (epoch_us(max(period_end)) - epoch_us(min(period_start))) / 86400000000.0 ELSE 0 END::DOUBLE AS recency, ((epoch_us({au.RFM_AT}) - epoch_us(min(period_start))) / 86400000000.0)::DOUBLE AS "T" FROM periods WHERE period_end <= {au.RFM_AT} GROUP BY 1)"""


@REG.query(f"WITH {au.PERIODS}, {_BG} SELECT * FROM bg")
def agg_bgnbd_in(spark: SparkSession, d: str) -> DataFrame:
    return mo.bgnbd_inputs(au.periods(spark, d), au.at())


@REG.query(f"WITH {au.PERIODS} SELECT customer_id, sum(total_orders)::BIGINT AS frequency, round(sum(total_spend)::DOUBLE / sum(total_orders) + 1e-9, 2)::DECIMAL(18,2) AS monetary_value FROM periods GROUP BY 1 HAVING sum(total_orders) >= 2")
def agg_gg_in(spark: SparkSession, d: str) -> DataFrame:
    return mo.gamma_gamma_inputs(au.periods(spark, d))


FIXED_BG, FIXED_GG = mo.BgNbd(0.8, 40.0, 0.9, 3.0), mo.GammaGamma(2.0, 3.0, 60.0)


@REG.query(f"WITH {au.PERIODS}, {_BG} SELECT customer_id, round(CASE WHEN frequency > 0 THEN 1 / (1 + 0.9::DOUBLE / (3.0 + frequency - 1) * power((40.0::DOUBLE + \"T\") / (40.0 + recency), 0.8 + frequency)) ELSE 1 END, 9) AS prob_alive FROM bg")
def ml_prob_alive(spark: SparkSession, d: str) -> DataFrame:
    return agg_bgnbd_in(spark, d).select("customer_id", F.round(mo.prob_alive(FIXED_BG), 9).alias("prob_alive"))


@REG.query()
def ml_bgnbd(spark: SparkSession, d: str) -> DataFrame:
    """Fits the model and scores every customer for a year."""
    inputs = checkpointed(agg_bgnbd_in(spark, d))  # read by the fit and the scores
    model = mo.fit_bgnbd(inputs)
    return inputs.select("customer_id", mo.expected_purchases(model, mo.horizon_days(12))("frequency", "recency", "T").alias("predicted_purchases"), mo.prob_alive(model).alias("prob_alive"))


def _diagnosed(draws: DataFrame) -> DataFrame:
    draws = checkpointed(draws)
    moments = draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return moments.join(mo.mcmc_diagnostics(draws), "parameter")


@REG.query()
def ml_bgnbd_mcmc(spark: SparkSession, d: str) -> DataFrame:
    """Posterior mean and deviation of each parameter, with the diagnostics of the chains."""
    return _diagnosed(mo.sample_bgnbd(checkpointed(agg_bgnbd_in(spark, d))))


@REG.query()
def ml_gg_mcmc(spark: SparkSession, d: str) -> DataFrame:
    return _diagnosed(mo.sample_gamma_gamma(checkpointed(agg_gg_in(spark, d))))


@REG.query()
def ml_gg(spark: SparkSession, d: str) -> DataFrame:
    inputs = checkpointed(agg_gg_in(spark, d))  # read by the fit and the scores
    return inputs.select("customer_id", mo.expected_spend(mo.fit_gamma_gamma(inputs)).alias("predicted_avg_value"))


@REG.query(f"""WITH {au.PERIODS}, {_BG}, gg AS (SELECT customer_id, 2.0::DOUBLE * (60.0 + sum(total_orders) * round(sum(total_spend)::DOUBLE / sum(total_orders) + 1e-9, 2)) / (2.0 * sum(total_orders) + 3.0 - 1) AS v FROM periods GROUP BY 1 HAVING sum(total_orders) >= 2),
pp AS (SELECT customer_id, frequency / 3.0::DOUBLE AS p, CASE WHEN frequency > 0 THEN 1 / (1 + 0.9::DOUBLE / (3.0 + frequency - 1) * power((40.0::DOUBLE + "T") / (40.0 + recency), 0.8 + frequency)) ELSE 1 END AS a FROM bg)
SELECT customer_id, round_even(p::DECIMAL(38,10), 2)::DOUBLE AS predicted_purchases, round_even(coalesce(v, 0)::DECIMAL(38,10), 2)::DOUBLE AS predicted_avg_value, round_even((p * coalesce(v, 0) * 0.3::DOUBLE / 1.1::DOUBLE)::DECIMAL(38,10), 2)::DOUBLE AS clv, round_even(a::DECIMAL(38,10), 3)::DOUBLE AS prob_alive FROM pp LEFT JOIN gg USING (customer_id)""")
def ml_clv(spark: SparkSession, d: str) -> DataFrame:
    """The value formula over given predictions and fixed parameters."""
    inputs = agg_bgnbd_in(spark, d)
    purchases = inputs.select("customer_id", (F.col("frequency") / 3.0).alias("predicted_purchases"))
    alive = inputs.select("customer_id", mo.prob_alive(FIXED_BG).alias("prob_alive"))
    spend = agg_gg_in(spark, d).select("customer_id", mo.expected_spend(FIXED_GG).alias("predicted_avg_value"))
    return mo.clv(purchases, alive, spend)


@REG.query("SELECT c_custkey AS customer_id, coalesce(n, 0) AS predicted_purchases, s AS predicted_avg_value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = k")
def jn_clv(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id")), table(spark, d, "orders").withColumnRenamed("o_custkey", "customer_id")
    n = o.groupBy("customer_id").agg(F.count(F.lit(1)).alias("predicted_purchases"))
    s = o.filter("o_orderstatus = 'F'").groupBy("customer_id").agg(F.max("o_totalprice").alias("predicted_avg_value"))
    return c.join(n, "customer_id", "left").join(s, "customer_id", "left").fillna(0, ["predicted_purchases"])


def _draws(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit("value").alias("parameter"), (F.col("event_id") % 4).alias("chain"), F.col("event_id").alias("draw"), "value", (F.col("event_id") % 50).alias("obs_id"))


@REG.query("""WITH c AS (SELECT event_id % 4 AS chain, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), p AS (SELECT avg(n) AS n, var_samp(m) AS b, avg(v) AS w, min(n) // 2 AS half FROM c),
r AS (SELECT event_id % 4 AS chain, value, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_id % 4) AS n FROM events WHERE value IS NOT NULL),
h AS (SELECT chain, k <= half AS front, CASE WHEN k <= half THEN k ELSE k - (r.n - half) END AS i, value, half FROM r, p WHERE k <= half OR k > r.n - half), d AS (SELECT *, value - avg(value) OVER (PARTITION BY chain, front) AS x FROM h),
l AS (SELECT lag, sum(a.x * b.x) / any_value(a.half) / 8 AS cov FROM d a JOIN d b ON a.chain = b.chain AND a.front = b.front JOIN (SELECT unnest(range(0, 40)) AS lag) ON b.i = a.i + lag GROUP BY 1),
w AS (SELECT any_value(half) AS half, (SELECT cov FROM l WHERE lag = 0) * any_value(half) / (any_value(half) - 1) AS within, var_samp(m) AS between FROM (SELECT chain, front, any_value(half) AS half, avg(value) AS m FROM h GROUP BY 1, 2)),
g AS (SELECT lag // 2 AS pair, sum(CASE WHEN lag = 0 THEN 1 ELSE 1 - (within - cov * half / (half - 1)) / (within * (half - 1) / half + between) END) AS s FROM l, w GROUP BY 1), f AS (SELECT coalesce(min(pair) FILTER (WHERE s <= 0), 20) AS stop FROM g),
t AS (SELECT -1 + 2 * sum(s) AS tau FROM (SELECT min(s) OVER (ORDER BY pair) AS s FROM g, f WHERE pair < stop)) SELECT 'value' AS parameter, round(sqrt(((n - 1) / n * p.w + coalesce(b, 0)) / p.w), 6) AS r_hat, round(least(8 * p.half / tau, 8 * p.half * log10(8 * p.half)), 2) AS ess, true AS ok FROM p, t""")
def ml_mcmc_diag(spark: SparkSession, d: str) -> DataFrame:
    return mo.mcmc_diagnostics(_draws(spark, d)).withColumns({"r_hat": F.round("r_hat", 6), "ess": F.round("ess", 2)})


@REG.query("""WITH q AS (SELECT event_id % 50 AS o, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.975) AS b FROM events GROUP BY 1), x AS (SELECT event_id % 50 AS o, avg(value) AS v FROM events GROUP BY 1)
SELECT avg(CASE WHEN v BETWEEN a AND b THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage_95, round(median(v), 6) AS observed_median, round(median(m), 6) AS predicted_median FROM q JOIN x USING (o)""")
def ml_ppc(spark: SparkSession, d: str) -> DataFrame:
    draws = _draws(spark, d)
    out = mo.posterior_checks(draws, draws.groupBy("obs_id").agg(F.avg("value").alias("observed")))
    return out.withColumns({c: F.round(c, 6) for c in ("observed_median", "predicted_median")})


# ---------------------------------------------------------------- event windows over the stored events


def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """The events with a zoned time, as a stream would have it (UTC session)."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _agg_sql(group: str) -> str:
    return f"count(*) AS count, round(coalesce(sum(value), 0), 6) AS sum, round(coalesce(avg(value), 0), 6) AS avg, min(value) AS min, max(value) AS max, count(DISTINCT value) AS distinct_count, list_sort(list(value))[least(floor(count(value) * 95.0 / 100) + 1, count(value))::BIGINT] AS percentile {group}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.drop("first", "last").withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


@REG.query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {_agg_sql('FROM events GROUP BY 1, 2, 3')}")
def st_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_rounded(wi.tumbling(stream_events(spark, d), "ts", "1 hour", ["event_type"], wi.aggregates(F.col("value"), "ts"))))


@REG.query(f"WITH x AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES, time_bucket(INTERVAL 30 MINUTES, ts)]) AS window_start FROM events) SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, {_agg_sql('FROM x GROUP BY 1, 2, 3')}")
def st_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_rounded(wi.sliding(stream_events(spark, d), "ts", "1 hour", "30 minutes", ["event_type"], wi.aggregates(F.col("value"), "ts"))))


@REG.query(f"WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOURS AS window_end, user_id, {_agg_sql('FROM y GROUP BY user_id, s')}")
def st_session(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_rounded(wi.session(stream_events(spark, d), "ts", ["user_id"], wi.aggregates(F.col("value"), "ts"), "2 hours")))


@REG.query("SELECT event_type, count(*) AS count, round(coalesce(sum(value), 0), 6) AS sum, round(coalesce(avg(value), 0), 6) AS avg, min(value) AS min, max(value) AS max, count(DISTINCT value) AS distinct_count FROM events GROUP BY 1")
def st_global(spark: SparkSession, d: str) -> DataFrame:
    """The global window has no bound, so it keeps no list of values: its percentile is a sketch, left out here."""
    columns = [*wi.aggregates(F.col("value"), "ts", exact=False)[:5], F.count_distinct("value").alias("distinct_count")]
    return wi.overall(stream_events(spark, d), ["event_type"], columns).withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


@REG.query(f"SELECT user_id, arg_min(value, ts) AS first, arg_max(value, ts) AS last, {_agg_sql('FROM events GROUP BY 1')}")
def st_agg(spark: SparkSession, d: str) -> DataFrame:
    """All nine aggregates of each user's events."""
    out = wi.overall(stream_events(spark, d), ["user_id"], wi.aggregates(F.col("value"), "ts"))
    return out.withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


@REG.query()
def st_emit(spark: SparkSession, d: str) -> DataFrame:
    """The stored events read as a stream, in append mode behind the watermark, until none is left."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet" if not os.path.isdir(f"{d}/events.parquet") else "*.parquet").parquet(d if not os.path.isdir(f"{d}/events.parquet") else f"{d}/events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark)
    out = wi.tumbling(stream, "ts", "1 hour", ["event_type"], wi.aggregates(F.col("value"), "ts", streaming=True))
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@REG.query("WITH e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) SELECT w AS window_start, event_type, count(*) AS count, round(coalesce(sum(value), 0), 6) AS sum, min(value) AS min, max(value) AS max FROM e WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 SECONDS FROM events) GROUP BY 1, 2")
def st_emit_closed(spark: SparkSession, d: str) -> DataFrame:
    """What a stream of the events emits exactly: the windows that the watermark has closed."""
    return st_emit(spark, d).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "count", F.round("sum", 6).alias("sum"), "min", "max")


@REG.query("SELECT count(*) AS n, count(*) FILTER (WHERE k > 50) AS high FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def prj_json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(k > 50).alias("high"))


@REG.query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3')")
def flt_subscription(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(ev.subscription({"k": [1, 2, 3]}, "props")).select("event_id")


@REG.query("SELECT event_id, json_extract_string(props, '$.k') AS k, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS weekday FROM events")
def prj_features(spark: SparkSession, d: str) -> DataFrame:
    return ev.features_of(table(spark, d, "events"), {"k": "k"}, "props").select("event_id", "k", "hour", "weekday")


@REG.query("SELECT subscriber, count(*) AS n FROM (SELECT unnest([CASE WHEN json_extract_string(props, '$.k') = '7' THEN 'seven' END, CASE WHEN json_extract_string(props, '$.k') IN ('7', '8') THEN 'both' END]) AS subscriber FROM events) WHERE subscriber IS NOT NULL GROUP BY 1")
def snk_ws(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumnRenamed("props", "payload")
    return ev.broadcast_to({"seven": {"k": 7}, "both": {"k": [7, 8]}})(events).groupBy("subscriber").agg(F.count(F.lit(1)).alias("n"))


@REG.query("SELECT CASE WHEN user_id % 10 = 0 THEN 'dead' ELSE 'good' END AS way, count(*) AS n FROM events GROUP BY 1")
def st_validate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 10 == 0, F.lit("nonsense")).otherwise(F.lit("custom"))
    raw = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("props").alias("payload"))).alias("value"))
    parsed = ev.parse(raw)
    return parsed.groupBy(F.when(F.size("errors") > 0, "dead").otherwise("good").alias("way")).agg(F.count(F.lit(1)).alias("n"))


@REG.query("SELECT event_id, value * 2 + user_id AS score FROM events")
def st_infer(spark: SparkSession, d: str) -> DataFrame:
    def load():
        return lambda x: x["value"] * 2 + x["user_id"]

    return table(spark, d, "events").select("event_id", wi.scorer(load)(F.struct("value", "user_id")).alias("score"))


_ALERT = "b AS (SELECT 'slow' AS rule, event_id, ts, value, value > 90 AS breached FROM events WHERE event_type = 'error')"


@REG.query(f"WITH {_ALERT}, l AS (SELECT *, coalesce(lag(breached) OVER (PARTITION BY rule ORDER BY ts), false) AS before FROM b) SELECT rule, ts, value, CASE WHEN breached THEN 'triggered' ELSE 'resolved' END AS state FROM l WHERE breached <> before")
def st_alert(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("slow", "error", "greater_than", 90.0)], "rule string, metric string, op string, threshold double")
    metrics = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_type").alias("metric"), "ts", "value")
    return wi.alert_changes(wi.breaches(metrics, rules))


@REG.query("SELECT event_id, round(0.4 * greatest(value / 100, 0.5) + 0.3 * user_id * 10 / 10000.0 + 0.2 * 50 / 1000.0 + 0.1 * 10 / 100.0, 9)::DOUBLE AS utilisation FROM events")
def st_autoscale(spark: SparkSession, d: str) -> DataFrame:
    u = wi.utilisation(F.col("value") / 100, F.lit(0.5), F.col("user_id") * 10, F.lit(50), F.lit(10))
    return table(spark, d, "events").select("event_id", F.round(u, 9).alias("utilisation"))


# ---------------------------------------------------------------- labels and charts


def _lens1(spark: SparkSession, d: str) -> DataFrame:
    return le.lens1(au.rfm_rows(spark, d))


def _lens1_sql() -> str:
    return f"WITH {au.PERIODS}, {au._rfm('rfm')}, {au._PARETO}, l1 AS (SELECT round((count(*) FILTER (WHERE frequency = 1))::DOUBLE / count(*) * 100 + 1e-9, 2) AS one, round(sum(frequency)::DOUBLE / count(*) + 1e-9, 2) AS ao, (SELECT revenue_share FROM share WHERE percent = 10) AS t10, (SELECT revenue_share FROM share WHERE percent = 20) AS t20 FROM rfm)"


@REG.query(f"{_lens1_sql()} SELECT greatest(least(100 - CASE WHEN one > 70 THEN 30 WHEN one > 50 THEN 15 ELSE 0 END - CASE WHEN t10 > 80 THEN 20 WHEN t10 > 60 THEN 10 ELSE 0 END + CASE WHEN ao > 3 THEN 10 ELSE 0 END, 100), 0)::INTEGER AS health, CASE WHEN t10 > 70 THEN 'high' WHEN t10 > 50 THEN 'medium' ELSE 'low' END AS risk, concat_ws('; ', CASE WHEN one > 60 THEN 'Win a second order from one-time buyers' END, CASE WHEN t10 > 70 THEN 'Reduce the dependence on top customers' END, CASE WHEN ao < 2 THEN 'Raise the order frequency' END) AS recommendations FROM l1")
def cls_lens1(spark: SparkSession, d: str) -> DataFrame:
    return _lens1(spark, d).select(la.lens1_health().alias("health"), la.lens1_risk().alias("risk"), F.array_join(la.lens1_recommendations(), "; ").alias("recommendations"))


@REG.query(f"{_lens1_sql()} SELECT * FROM (SELECT 'top 10%' AS slice, t10 AS share FROM l1 UNION ALL SELECT 'next 10%', (t20 - t10)::DECIMAL(18,2) FROM l1 UNION ALL SELECT 'the rest', (100 - t20)::DECIMAL(18,2) FROM l1)")
def chart_pareto(spark: SparkSession, d: str) -> DataFrame:
    return la.chart_pareto(_lens1(spark, d))


_L2 = au.REG.oracles["agg_lens2"]


@REG.query(f"""SELECT CASE WHEN customer_count_change > 0 AND revenue_change_pct > 10 THEN 'strong' WHEN customer_count_change > 0 OR revenue_change_pct > 0 THEN 'moderate' ELSE 'negative' END AS momentum,
 concat_ws('; ', CASE WHEN retention_rate > 80 THEN 'high retention' END, CASE WHEN retention_rate < 50 THEN 'low retention' END, CASE WHEN churn_rate > 30 THEN 'high churn' END, CASE WHEN new * 100.0 / (retained + new) > 30 THEN 'many new customers' END, CASE WHEN revenue_change_pct > 20 THEN 'revenue growth' END, CASE WHEN revenue_change_pct < -20 THEN 'revenue decline' END) AS drivers,
 concat_ws('; ', CASE WHEN retention_rate < 60 THEN 'Improve retention' END, CASE WHEN churn_rate > 40 THEN 'Find the causes of churn' END, CASE WHEN customer_count_change < 0 THEN 'Win more customers' END, CASE WHEN revenue_change_pct < -10 THEN 'Restore revenue' END, CASE WHEN retention_rate > 70 AND customer_count_change > 0 AND revenue_change_pct > 5 THEN 'Keep the course' END) AS recommendations FROM ({_L2})""")
def cls_lens2(spark: SparkSession, d: str) -> DataFrame:
    row = au.agg_lens2(spark, d)
    return row.select(la.lens2_momentum().alias("momentum"), F.array_join(la.lens2_drivers(), "; ").alias("drivers"), F.array_join(la.lens2_recommendations(), "; ").alias("recommendations"))


@REG.query(f"""WITH {au.PERIODS}, {au._MIGRATION}, s AS (SELECT count(*) FILTER (WHERE status = 'retained') AS r, count(*) FILTER (WHERE status = 'churned') AS c, count(*) FILTER (WHERE status = 'new') AS n, count(*) FILTER (WHERE status = 'reactivated') AS x FROM status_)
SELECT 'Period 1' AS source, 'Retained' AS target, r AS customers FROM s UNION ALL SELECT 'Retained', 'Period 2', r FROM s UNION ALL SELECT 'Period 1', 'Churned', c FROM s UNION ALL SELECT 'New', 'Period 2', n - x FROM s UNION ALL SELECT 'Reactivated', 'Period 2', x FROM s""")
def chart_sankey(spark: SparkSession, d: str) -> DataFrame:
    return la.chart_sankey(au.agg_lens2_status(spark, d))


@REG.query(f"""WITH l AS (SELECT *, active_customers * 100.0 / cohort_size AS r, row_number() OVER (PARTITION BY cohort_id ORDER BY period_number DESC) AS back FROM ({au.REG.oracles['agg_lens3']})),
g AS (SELECT cohort_id, count(*) AS n, max(r) FILTER (WHERE back = 1) AS last_r, sum(revenue_per_member) AS ltv, arg_min(revenue_per_member, period_number) AS first_v, arg_max(revenue_per_member, period_number) AS last_v, max(r) FILTER (WHERE period_number = 1) AS r1, avg(revenue_per_member) AS mean_v, max(cumulative_activation_rate) * 100 AS act, bool_and(r < 10) FILTER (WHERE back <= 3) AS low FROM l GROUP BY 1)
SELECT cohort_id, CASE WHEN n <= 2 THEN 'early' WHEN n <= 6 THEN 'growth' WHEN n <= 12 THEN 'mature' WHEN last_r < 10 THEN 'declining' ELSE 'mature' END AS maturity, CASE WHEN n < 2 THEN 'moderate' WHEN ltv > 500 THEN 'strong' WHEN n >= 3 AND last_v > 0.5 * first_v THEN 'moderate' WHEN ltv < 100 THEN 'weak' ELSE 'moderate' END AS ltv_trend,
 concat_ws('; ', CASE WHEN r1 < 30 THEN 'Improve the first repeat' END, CASE WHEN mean_v < 50 THEN 'Raise revenue per member' END, CASE WHEN act < 50 THEN 'Activate more of the cohort' END, CASE WHEN n >= 3 AND low THEN 'Win the cohort back' END) AS recommendations FROM g""")
def cls_lens3(spark: SparkSession, d: str) -> DataFrame:
    return la.lens3_labels(au.agg_lens3(spark, d))


@REG.query(f"WITH {au.PERIODS}, {au.COHORTS}, {au._LENS3} SELECT cohort_id, period_number, round(cumulative_activation_rate * 100, 4) AS rate_pct, active_customers FROM l3")
def chart_retention(spark: SparkSession, d: str) -> DataFrame:
    return la.chart_retention(au.agg_lens3(spark, d))


@REG.query(f"WITH {au.PERIODS}, {au.COHORTS}, {au._decomp(au._LEFT)} SELECT cohort_id, map_from_entries(list((period_number, pct_active) ORDER BY period_number))::VARCHAR AS cells FROM l4 GROUP BY 1")
def chart_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """All periods of each cohort; the cells as text, for a table's columns would follow the data."""
    rows = stored(au.agg_decomp(spark, d).select("cohort_id", "period_number", "pct_active"))
    periods = [r[0] for r in rows.select("period_number").distinct().orderBy("period_number").limit(10_001).collect()]  # a period each, not a customer
    if len(periods) > 10_000:
        raise ValueError("more than 10,000 periods don't make a chart")
    wide = la.chart_heatmap(rows, periods)
    cell = [F.when(F.col(f"`{p}`").isNotNull(), F.concat(F.lit(f"{p}="), F.col(f"`{p}`").cast("string"))) for p in periods]
    return wide.select("cohort_id", F.concat(F.lit("{"), F.concat_ws(", ", *cell), F.lit("}")).alias("cells"))


def _lens4(spark: SparkSession, d: str) -> DataFrame:
    decomposed, second = au.agg_decomp(spark, d), au.agg_ttsp(spark, d)
    per = decomposed.groupBy("cohort_id").agg((F.sum("total_revenue") / F.max("cohort_size")).alias("revenue_per_customer"), F.avg("aof").alias("frequency"), F.avg("aov").alias("aov"))
    return per.join(second, "cohort_id")


@REG.query(f"""WITH p AS (SELECT cohort_id, sum(total_revenue)::DOUBLE / max(cohort_size) AS rev, avg(aof) AS f, avg(aov) AS aov FROM ({au.REG.oracles['agg_decomp']}) GROUP BY 1), s AS (SELECT max(rev) AS rh, min(rev) AS rl, max(f) AS fh, min(f) AS fl, max(aov) AS ah, min(aov) AS al, max(median_days) AS mh, min(median_days) AS ml, avg(mean_days) AS t FROM p JOIN ({au.REG.oracles['agg_ttsp']}) USING (cohort_id))
SELECT concat_ws('; ', CASE WHEN (rh - rl) / nullif(rh, 0) > 0.5 THEN 'revenue differs' END, CASE WHEN fh / nullif(fl, 0) > 1.5 THEN 'frequency differs' END, CASE WHEN (ah - al) / nullif(ah, 0) > 0.3 THEN 'order value differs' END, CASE WHEN mh / nullif(ml, 0) > 1.5 THEN 'time to the second order differs' END) AS differences,
 concat_ws('; ', CASE WHEN rh / nullif(rl, 0) > 2 THEN 'Study what the best cohort bought' END, CASE WHEN fh / nullif(fl, 0) > 1.5 THEN 'Raise the frequency of weak cohorts' END, CASE WHEN ah / nullif(al, 0) > 1.3 THEN 'Raise the order value of weak cohorts' END, CASE WHEN t > 60 THEN 'Shorten the time to the second order' END) AS recommendations FROM s""")
def cls_lens4(spark: SparkSession, d: str) -> DataFrame:
    rows = _lens4(spark, d)
    return attach(la.lens4_differences(rows), la.lens4_recommendations(rows))


@REG.query(f"WITH {au.PERIODS}, {au.COHORTS}, {au._HEALTH} SELECT CASE WHEN health_score >= 90 THEN 'excellent' WHEN health_score >= 80 THEN 'good' WHEN health_score >= 70 THEN 'fair' WHEN health_score >= 60 THEN 'poor' ELSE 'critical' END AS assessment, concat_ws('; ', CASE WHEN retention_rate < 70 THEN 'Invest in retention' END, CASE WHEN repeat_trend = 'declining' THEN 'Study recent cohorts' END, CASE WHEN revenue_predictability_pct < 60 THEN 'Strengthen existing cohorts' END, CASE WHEN acquisition_dependence_pct > 35 THEN 'Balance acquisition with retention' END) AS recommendations FROM hs")
def cls_lens5_text(spark: SparkSession, d: str) -> DataFrame:
    t = la.lens5_texts()
    return au.agg_lens5(spark, d).select(t["assessment"].alias("assessment"), t["recommendations"].alias("recommendations"))


@REG.query("SELECT event_id, CASE WHEN v < 0.1 THEN 'low' WHEN v < 0.25 THEN 'medium' WHEN v < 0.5 THEN 'high' ELSE 'critical' END AS drift, CASE WHEN abs(v - 0.5) / 0.5 * 100 < 5 THEN 'none' WHEN abs(v - 0.5) / 0.5 * 100 < 15 THEN 'low' WHEN abs(v - 0.5) / 0.5 * 100 < 30 THEN 'medium' ELSE 'high' END AS performance FROM (SELECT event_id, round(value / 100, 3) AS v FROM events)")
def cls_model_drift(spark: SparkSession, d: str) -> DataFrame:
    v = F.round(F.col("value") / 100, 3)
    return table(spark, d, "events").select("event_id", la.model_drift_level(v).alias("drift"), la.performance_level(F.lit(0.5), v).alias("performance"))


@REG.query()
def snk_lenses_md(spark: SparkSession, d: str) -> DataFrame:
    text = la.audit_report({"Single period": _lens1(spark, d), "Two periods": au.agg_lens2(spark, d), "Evolution of cohorts": la.latest_of_cohorts(au.agg_lens3(spark, d)), "Comparison of cohorts": au.agg_cohort_summary(spark, d).orderBy("cohort_id"), "Overall health": au.agg_lens5(spark, d)})
    return spark.createDataFrame([(i, s) for i, s in enumerate(text.split("\n"))], "line int, text string")


@REG.query("SELECT * FROM (VALUES ('compare the periods', 'lens2'), ('what is our overall customer base health score', 'lens5'), ('hello', 'lens1'), ('pareto', 'lens1')) t(text, lenses)")
def route_text(spark: SparkSession, d: str) -> DataFrame:
    questions = ["compare the periods", "what is our overall customer base health score", "hello", "pareto"]
    return spark.createDataFrame([(q, ",".join(la.route(q))) for q in questions], "text string, lenses string")


# ---------------------------------------------------------------- synthetic data and file round trips


@REG.query("SELECT 1000::BIGINT AS customers, 1000::BIGINT AS distinct_customers, true AS inside")
def src_synth_customers(spark: SparkSession, d: str) -> DataFrame:
    people = sy.customers(spark, 1000, "2023-01-01", "2023-12-31")
    return people.agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("customer_id").alias("distinct_customers"), F.bool_and(F.col("acquisition_date").between("2023-01-01", "2023-12-31")).alias("inside"))


@REG.query()
def src_synth_txn(spark: SparkSession, d: str) -> DataFrame:
    return sy.transactions(sy.customers(spark, 500, "2023-01-01", "2023-12-31"), "2023-01-01", "2024-06-30")


@REG.query()
def src_scenarios(spark: SparkSession, d: str) -> DataFrame:
    people = sy.customers(spark, 200, "2023-01-01", "2023-12-31")
    out = None
    for name, s in sy.SCENARIOS.items():
        part = sy.transactions(people, "2023-01-01", "2024-06-30", s).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("order_id").alias("orders")).select(F.lit(name).alias("scenario"), "lines", "orders")
        out = part if out is None else out.union(part)
    return out


@REG.query("SELECT * FROM (VALUES ('Houston', 350::BIGINT), ('Dallas', 300), ('Austin', 200), ('San Antonio', 150)) t(city, n)")
def src_texas(spark: SparkSession, d: str) -> DataFrame:
    return sy.regional_client(spark).groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@REG.query()
def agg_synth_checks(spark: SparkSession, d: str) -> DataFrame:
    people = sy.customers(spark, 300, "2023-01-01", "2023-12-31", 45)
    return sy.checks(sy.transactions(people, "2023-01-01", "2024-06-30", sy.SCENARIOS["heavy_promotion"]), people, 6)


@REG.query(f"WITH {au.PERIODS}, {au.COHORTS}, {au._LENS3}, r AS (SELECT cohort_id, period_number, round(active_customers / cohort_size, 9) AS retention FROM l3), q AS (SELECT cohort_id, period_number, retention / nullif(lag(retention) OVER (PARTITION BY cohort_id ORDER BY period_number), 0) AS ratio FROM r) SELECT cohort_id, period_number, round(ratio, 6) AS ratio, ratio <= 2 AS ok FROM q WHERE ratio IS NOT NULL")
def win_decay(spark: SparkSession, d: str) -> DataFrame:
    r = au.agg_lens3(spark, d).select("cohort_id", "period_number", F.round(F.col("active_customers") / F.col("cohort_size"), 9).alias("retention"))
    return sy.decay(r).withColumn("ratio", F.round("ratio", 6))


for _suffix in ("csv", "json", "parquet"):

    def _round_trip(spark: SparkSession, d: str, suffix: str = _suffix) -> DataFrame:
        path = f"{scratch(spark)}.{suffix}"
        nations = table(spark, d, "nation")
        files.write_by_suffix(nations, path)
        return files.read_by_suffix(spark, path, nations.schema).select("n_nationkey", "n_name", "n_regionkey")

    REG.query("SELECT n_nationkey, n_name, n_regionkey FROM nation", name=f"src_file_{_suffix}")(_round_trip)


@REG.query("SELECT count(*) AS transactions, count(DISTINCT customer_id) AS customers, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM txn_lines")
def src_json_txn(spark: SparkSession, d: str) -> DataFrame:
    """The lines written as JSON with ISO times and read back as transactions."""
    path = scratch(spark)
    lines = table(spark, d, "txn_lines").select("order_id", "customer_id", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_ts"), "product_id", "quantity", "unit_price", "unit_cost")
    lines.write.json(path)
    raw = spark.read.schema(files.TRANSACTIONS).json(path)
    return files.transactions_summary(files.with_times(raw))


