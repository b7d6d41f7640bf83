"""Queries of drift, quality, profiles, experiments, features, lineage and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import experiments as ex
from tidemark.operators import features as fs
from tidemark.operators import lineage as li
from tidemark.operators import quality as qu
from tidemark.operators import workflow as wf
from tidemark.registry import Registry
from tidemark.session import table

REG = Registry()
CUT = "l_shipdate < TIMESTAMP_NTZ'1998-01-01'"
SQL_CUT = "l_shipdate < TIMESTAMP '1998-01-01'"


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "lineitem")
    return t.filter(CUT), t.filter(f"NOT ({CUT})")


# ---------------------------------------------------------------- drift

_METRICS = ("l_quantity", "l_extendedprice", "l_discount")
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS x, {SQL_CUT} AS base FROM lineitem WHERE {m} IS NOT NULL" for m in _METRICS)
_PSI = f"""v AS ({_LONG}), e0 AS (SELECT metric, list_sort(list_distinct(quantile_cont(x, [{", ".join(repr(k / 10) for k in range(11))}]) FILTER (WHERE base))) AS p, min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE base) AS nb, count(*) FILTER (WHERE NOT base) AS nc FROM v GROUP BY 1),
e AS (SELECT metric, nb, nc, list_concat([lo - 1e-6], p[2:len(p) - 1], [hi + 1e-6]) AS edges FROM e0),
g AS (SELECT metric, nb, nc, edges, unnest(range(0, len(edges) - 1)) AS bin FROM e),
h AS (SELECT g.metric, g.bin, any_value(nb) AS nb, any_value(nc) AS nc, count(*) FILTER (WHERE base) AS b, count(*) FILTER (WHERE NOT base) AS c FROM g JOIN v ON v.metric = g.metric AND x >= edges[bin + 1] AND (x < edges[bin + 2] OR (bin = len(edges) - 2 AND x <= edges[bin + 2])) GROUP BY 1, 2),
s AS (SELECT g.metric, CASE WHEN coalesce(b, 0) = 0 THEN 1e-6 ELSE b / g.nb END AS pb, CASE WHEN coalesce(c, 0) = 0 THEN 1e-6 ELSE c / g.nc END AS pc FROM g LEFT JOIN h USING (metric, bin)),
psi AS (SELECT metric, sum((pc - pb) * ln(pc / pb)) AS psi FROM s GROUP BY 1)"""


@REG.query(f"WITH {_PSI} SELECT metric, round(psi, 9) AS psi FROM psi")
def agg_psi(spark: SparkSession, d: str) -> DataFrame:
    a, b = halves(spark, d)
    return dr.psi(dr.long_form(a, list(_METRICS)), dr.long_form(b, list(_METRICS))).withColumn("psi", F.round("psi", 9))


@REG.query(f"WITH {_PSI} SELECT metric, round(psi, 9) AS drift_score, psi >= 0.2 AS drift_detected, 0.2::DOUBLE AS threshold, CASE WHEN psi < 0.1 THEN 'No significant drift' WHEN psi < 0.25 THEN 'Small drift, investigation recommended' ELSE 'Significant drift, retraining recommended' END AS interpretation FROM psi")
def agg_feature_drift(spark: SparkSession, d: str) -> DataFrame:
    return dr.feature_drift(*halves(spark, d), list(_METRICS)).withColumn("drift_score", F.round("drift_score", 9))


_KS = f"""c AS (SELECT l_extendedprice AS x, count(*) FILTER (WHERE {SQL_CUT}) AS a, count(*) FILTER (WHERE NOT ({SQL_CUT})) AS b FROM lineitem GROUP BY 1),
r AS (SELECT (sum(a) OVER w) / (SELECT sum(a) FROM c) - (sum(b) OVER w) / (SELECT sum(b) FROM c) AS gap FROM c WINDOW w AS (ORDER BY x))"""


@REG.query(f"WITH {_KS} SELECT round(max(abs(gap)), 9) AS d, (SELECT sum(a) FROM c)::BIGINT AS n, (SELECT sum(b) FROM c)::BIGINT AS m FROM r")
def agg_ks(spark: SparkSession, d: str) -> DataFrame:
    return dr.ks_statistic(*halves(spark, d), "l_extendedprice").withColumn("d", F.round("d", 9))


@REG.query("SELECT x, round(sum(k) OVER (ORDER BY x) / sum(k) OVER (), 9)::DOUBLE AS share FROM (SELECT l_extendedprice::DOUBLE AS x, count(*) AS k FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1)")
def win_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return dr.ecdf(table(spark, d, "lineitem"), "l_extendedprice").select("x", F.round("share", 9).alias("share"))


@REG.query("""WITH t AS (SELECT event_id % 3 = 0 AS ks, value / 100 AS s, value / 5000 AS p FROM events)
SELECT count(*) AS total_tests, count(*) FILTER (WHERE CASE WHEN ks THEN p < 0.05 ELSE s >= 0.2 END) AS drift_count, count(*) FILTER (WHERE CASE WHEN ks THEN p < 0.001 ELSE s >= 0.25 END) AS high_severity,
 count(*) FILTER (WHERE CASE WHEN ks THEN p >= 0.001 AND p < 0.01 ELSE s >= 0.1 AND s < 0.25 END) AS medium_severity, count(*) FILTER (WHERE CASE WHEN ks THEN coalesce(p >= 0.01, true) ELSE coalesce(s < 0.1, true) END) AS low_severity FROM t""")
def agg_drift_summary(spark: SparkSession, d: str) -> DataFrame:
    """Over the events as test results: every third one a test with a p-value, the others scores."""
    s, p, ks = F.col("value") / 100, F.col("value") / 5000, F.col("event_id") % 3 == 0
    return dr.drift_summary(table(spark, d, "events").select(F.when(ks, "ks").otherwise("psi").alias("test_type"), s.alias("drift_score"), F.when(ks, p).alias("p_value"), F.when(ks, p < 0.05).otherwise(s >= 0.2).alias("drift_detected")))


_TENTHS = ", ".join(repr(k / 10) for k in range(11))


@REG.query(f"""WITH v AS (SELECT l_quantity::DOUBLE AS x, {SQL_CUT} AS ref FROM lineitem WHERE l_quantity IS NOT NULL AND l_shipdate IS NOT NULL), e AS (SELECT list_sort(list_distinct(quantile_cont(x, [{_TENTHS}]) FILTER (WHERE ref))) AS e FROM v),
b AS (SELECT e, unnest(range(0, len(e) - 1)) AS bin FROM e), n AS (SELECT bin, count(x) FILTER (WHERE ref) AS r, count(x) FILTER (WHERE NOT ref) AS c FROM b LEFT JOIN v ON x >= e[bin + 1] AND (x < e[bin + 2] OR bin = len(e) - 2 AND x = e[bin + 2]) GROUP BY 1),
s AS (SELECT CASE WHEN r = 0 THEN 1e-6 ELSE r / sum(r) OVER () END AS pr, CASE WHEN c = 0 THEN 1e-6 ELSE c / sum(c) OVER () END AS pc FROM n) SELECT round(abs(sum((pc - pr) * ln(pc / pr))), 9) AS psi FROM s""")
def agg_model_psi(spark: SparkSession, d: str) -> DataFrame:
    return dr.model_psi(*halves(spark, d), "l_quantity").withColumn("psi", F.round("psi", 9))


_CATEGORIES = f"""c AS (SELECT l_returnflag, count(*) FILTER (WHERE {SQL_CUT}) AS b, count(*) FILTER (WHERE NOT ({SQL_CUT})) AS c FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1), s AS (SELECT greatest(b / (SELECT sum(b) FROM c), 1e-6) AS pb, greatest(c / (SELECT sum(c) FROM c), 1e-6) AS pc FROM c)"""


@REG.query(f"WITH {_CATEGORIES} SELECT round(least(sum((pc - pb) * ln(pc / pb)), 1.0), 9) AS psi FROM s")
def agg_categorical_psi(spark: SparkSession, d: str) -> DataFrame:
    return dr.categorical_psi(*halves(spark, d), "l_returnflag", 1.0).withColumn("psi", F.round("psi", 9))


@REG.query(f"WITH {_CATEGORIES} SELECT l_returnflag, b AS expected, c AS observed FROM c")
def agg_chi2(spark: SparkSession, d: str) -> DataFrame:
    return dr.category_counts(*halves(spark, d), "l_returnflag")


_BASELINE = """(SELECT count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max, {0} FROM (SELECT o_totalprice AS x FROM orders))""".format(", ".join(f"list_sort(list(x))[floor({p} / 100.0 * (count(x) - 1))::BIGINT + 1] AS p{p}" for p in (5, 25, 50, 75, 95)))


@REG.query(f"SELECT * FROM {_BASELINE}")
def agg_fs_baseline(spark: SparkSession, d: str) -> DataFrame:
    return dr.feature_baseline(table(spark, d, "orders"), "o_totalprice").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@REG.query("WITH b AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'F') SELECT round(least((abs(c.m - b.m) / b.s + abs(c.s - b.s) / b.s) / 2, 1.0), 9) AS drift_score, CASE WHEN drift_score >= 0.5 THEN 'high_drift' WHEN drift_score >= 0.3 THEN 'medium_drift' WHEN drift_score >= 0.1 THEN 'low_drift' ELSE 'no_drift' END AS status FROM b, c")
def agg_fs_drift(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    sides = [dr.feature_baseline(o.filter(w), "o_totalprice") for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    return dr.feature_shift(*sides).select(F.round("drift_score", 9).alias("drift_score"), dr.drift_status(F.col("drift_score")).alias("status"))


# ---------------------------------------------------------------- quality and profiles

SUITE = [qu.Expectation("row_count_between", options={"low": 1}), qu.Expectation("column_exists", "customer_id"), qu.Expectation("column_exists", "nothing"), qu.Expectation("not_null", "customer_id"), qu.Expectation("not_null", "acquisition_ts"), qu.Expectation("unique", "customer_id")]


@REG.query("""SELECT 'row_count_between' AS kind, '' AS "column", true AS success, count(*) AS observed FROM customer_identifiers UNION ALL SELECT 'column_exists', 'customer_id', true, 1 UNION ALL SELECT 'column_exists', 'nothing', false, 0
UNION ALL SELECT 'not_null', 'customer_id', count(*) = 0, count(*) FROM customer_identifiers WHERE customer_id IS NULL UNION ALL SELECT 'not_null', 'acquisition_ts', count(*) = 0, count(*) FROM customer_identifiers WHERE acquisition_ts IS NULL
UNION ALL SELECT 'unique', 'customer_id', coalesce(sum(k - 1), 0) = 0, coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM customer_identifiers GROUP BY customer_id)""")
def agg_dq(spark: SparkSession, d: str) -> DataFrame:
    return qu.run_suite(table(spark, d, "customer_identifiers"), SUITE)


@REG.query("SELECT 'low rate' AS rule, 'success_rate_below' AS kind UNION ALL SELECT 'nulls', 'expectation_failed' WHERE (SELECT count(*) FROM customer_identifiers WHERE customer_id IS NULL OR acquisition_ts IS NULL) > 0")
def agg_alerts(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("low rate", "success_rate_below", 0.95, 60, None), ("many", "failures_above", 50.0, 60, None), ("nulls", "expectation_failed", None, 60, "not_null"), ("quiet", "success_rate_below", 0.95, 600, None)], "rule string, kind string, threshold double, cooldown_s int, rules_name string")
    fired = spark.createDataFrame([("quiet", 30), ("low rate", 100)], "rule string, age_s int")
    return qu.alerts(qu.run_suite(table(spark, d, "customer_identifiers"), SUITE), rules, fired)


@REG.query("SELECT count(*) AS row_count, 6 AS column_count, {0} AS missing_cells, round(({0}) / (count(*) * 6.0) * 100, 6) AS missing_pct, (SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM scoring_labels GROUP BY ALL))::BIGINT AS duplicate_rows FROM scoring_labels".format(" + ".join(f"(count(*) - count({c}))" for c in ("label_id", "customer_id", "label_ts", "label_kind", "outcome", "ingested_at"))).replace("SELECT count(*) AS k FROM scoring_labels GROUP BY ALL", "SELECT count(*) AS k FROM scoring_labels GROUP BY label_id, customer_id, label_ts, label_kind, outcome, ingested_at"))
def agg_profile(spark: SparkSession, d: str) -> DataFrame:
    return qu.profile(table(spark, d, "scoring_labels"))


def _num_sql(t: str, c: str) -> str:
    return f"""(SELECT '{c}' AS "column", count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(stddev_samp(x), 4) AS std, round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis,
 count(*) FILTER (WHERE x = 0) AS zeros_count, count(*) FILTER (WHERE x < 0) AS negative_count, (SELECT count(*) FROM {t}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {t}) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers_count FROM (SELECT {c}::DOUBLE AS x FROM {t}))"""


@REG.query(" UNION ALL ".join("SELECT * FROM " + _num_sql("orders", c) for c in ("o_totalprice", "o_custkey")))
def agg_profile_num(spark: SparkSession, d: str) -> DataFrame:
    out = qu.profile_numeric(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    rounded = {c: F.round(c, 4 if c == "std" else 6) for c in ("mean", "q1", "median", "q3", "iqr", "std", "skewness", "kurtosis")}
    return out.drop("variance", "outliers_percentage").withColumns(rounded)


@REG.query("SELECT max(length(s)) AS max_length, min(length(s)) AS min_length, round(avg(length(s)), 6) AS avg_length FROM (SELECT coalesce(customer_id, 'nan') AS s FROM txn_lines)")
def agg_profile_cat(spark: SparkSession, d: str) -> DataFrame:
    return qu.profile_text(table(spark, d, "txn_lines"), "customer_id").withColumns({"avg_length": F.round("avg_length", 6), "max_length": F.col("max_length").cast("bigint"), "min_length": F.col("min_length").cast("bigint")})


@REG.query("SELECT product_id, count(*) AS count FROM txn_lines WHERE product_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_profile_top(spark: SparkSession, d: str) -> DataFrame:
    return qu.top_values(table(spark, d, "txn_lines"), "product_id")


@REG.query("SELECT min(event_ts) AS min, max(event_ts) AS max, floor((epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / 86400000000.0)::BIGINT AS range_days FROM txn_lines")
def agg_profile_dt(spark: SparkSession, d: str) -> DataFrame:
    return qu.profile_datetime(table(spark, d, "txn_lines"), "event_ts")


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@REG.query(" UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def agg_corr(spark: SparkSession, d: str) -> DataFrame:
    return qu.correlations(table(spark, d, "lineitem"), list(_CORR)).withColumn("correlation", F.round("correlation", 6))


def _profile_sql(name: str, where: str) -> str:
    columns = ("label_id", "customer_id", "label_ts", "label_kind", "outcome", "ingested_at")
    missing = " + ".join(f"count(*) - count({c})" for c in columns)
    return f"{name} AS (SELECT count(*) AS n, round(({missing}) / (count(*) * 6.0) * 100, 6) AS missing, (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM scoring_labels WHERE {where} GROUP BY {', '.join(columns)})) AS twice FROM scoring_labels WHERE {where})"


@REG.query(f"WITH {_profile_sql('a', 'outcome')}, {_profile_sql('b', 'true')} SELECT b.n - a.n AS row_count_change, 0::INTEGER AS column_count_change, round(b.missing - a.missing, 6)::DOUBLE AS missing_pct_change, b.twice - a.twice AS duplicate_rows_change, concat_ws('; ', CASE WHEN abs(b.n - a.n) > 0.1 * a.n THEN 'row count changed' END, CASE WHEN b.missing - a.missing > 5 THEN 'more missing values' END) AS warnings FROM a, b")
def agg_profile_cmp(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "scoring_labels")
    return qu.compare_profiles(qu.profile(t.filter("outcome")), qu.profile(t)).withColumn("missing_pct_change", F.round("missing_pct_change", 6))


@REG.query("""WITH f AS (SELECT quantile_cont(total_spend::DOUBLE, 0.25) AS a, quantile_cont(total_spend::DOUBLE, 0.75) AS b, quantile_cont(total_quantity::DOUBLE, 0.25) AS c, quantile_cont(total_quantity::DOUBLE, 0.75) AS e FROM order_aggregations),
s AS (SELECT count(*) AS total_samples, ((count(*) - count(total_spend)) / count(*) + (count(*) - count(total_quantity)) / count(*) + (count(*) - count(event_name)) / count(*)) / 3 AS m,
 (count(*) FILTER (WHERE total_spend < a - 1.5 * (b - a) OR total_spend > b + 1.5 * (b - a)) / count(*) + count(*) FILTER (WHERE total_quantity < c - 1.5 * (e - c) OR total_quantity > e + 1.5 * (e - c)) / count(*)) / 2 AS o FROM order_aggregations, f)
SELECT total_samples, round(m, 9) AS missing_share, round(o, 9) AS outlier_share, round((2 - m - o) / 2, 9) AS overall_score FROM s""")
def agg_model_dq(spark: SparkSession, d: str) -> DataFrame:
    out = qu.model_quality(table(spark, d, "order_aggregations"), ["total_spend", "total_quantity", "event_name"])
    return out.withColumns({c: F.round(c, 9) for c in ("missing_share", "outlier_share", "overall_score")})


@REG.query("""WITH r AS (SELECT outcome AS y, label_id % 3 = 0 AS z FROM scoring_labels WHERE outcome IS NOT NULL AND label_id IS NOT NULL), k AS (SELECT DISTINCT y AS k FROM r),
p AS (SELECT k, (SELECT count(*) FROM r WHERE y = k) AS s, (SELECT count(*) FROM r WHERE z = k) AS said, (SELECT count(*) FROM r WHERE y = k AND z = k) AS hit FROM k),
q AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS pr, hit / s AS rc FROM p)
SELECT round(sum(hit) / sum(s), 9) AS accuracy, round(sum(pr * s) / sum(s), 9) AS precision, round(sum(rc * s) / sum(s), 9) AS recall, round(sum(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) * s) / sum(s), 9) AS f1 FROM q""")
def agg_perf(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "scoring_labels").withColumn("guess", F.col("label_id") % 3 == 0)
    return qu.classification_metrics(t, "outcome", "guess").select(*[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_TWO = "round_even(({0})::DECIMAL(28,10), {1})::DECIMAL(18,{1})"


@REG.query(f"""WITH r AS (SELECT total_spend::DOUBLE AS a, total_quantity * 20.0::DOUBLE AS p FROM order_aggregations WHERE total_spend IS NOT NULL AND total_quantity IS NOT NULL)
SELECT {_TWO.format('avg(abs(a - p))', 2)} AS mae, {_TWO.format('avg(abs((a - p) / a)) FILTER (WHERE a <> 0) * 100', 2)} AS mape, {_TWO.format('sqrt(avg((a - p) * (a - p)))', 2)} AS rmse, {_TWO.format('abs(sum(a) - sum(p)) / sum(a) * 100', 2)} AS arpe, {_TWO.format('1 - avg((a - p) * (a - p)) / var_pop(a)', 4)} AS r_squared, count(*) AS sample_size FROM r""")
def agg_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "order_aggregations").select(F.col("total_spend").alias("actual"), (F.col("total_quantity") * 20.0).alias("predicted"))
    return qu.regression_metrics(t)


@REG.query("SELECT 'train' AS part, count(*) FILTER (WHERE order_ts < TIMESTAMP '2024-01-01') AS n FROM order_aggregations UNION ALL SELECT 'observation', count(*) FILTER (WHERE order_ts <= TIMESTAMP '2024-04-01') FROM order_aggregations UNION ALL SELECT 'test', count(*) FILTER (WHERE order_ts >= TIMESTAMP '2024-01-01' AND order_ts <= TIMESTAMP '2024-04-01') FROM order_aggregations")
def flt_temporal_split(spark: SparkSession, d: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    parts = qu.temporal_split(table(spark, d, "order_aggregations"), "order_ts", day("2024-01-01"), day("2024-04-01"))
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, p in parts.items()]
    return out[0].union(out[1]).union(out[2])


@REG.query("SELECT customer_id, sum(total_spend)::DECIMAL(28,2) AS actual, any_value(p.predicted) AS predicted FROM order_aggregations JOIN (SELECT customer_id, count(*) * 50.0::DOUBLE AS predicted FROM customer_identifiers WHERE customer_id IS NOT NULL GROUP BY 1) p USING (customer_id) WHERE order_ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def jn_actual_pred(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "order_aggregations").filter("order_ts >= TIMESTAMP_NTZ'2024-01-01'").groupBy("customer_id").agg(F.sum("total_spend").cast("decimal(28,2)").alias("actual"))
    predicted = table(spark, d, "customer_identifiers").filter("customer_id is not null").groupBy("customer_id").agg((F.count(F.lit(1)) * 50.0).alias("predicted"))
    return actual.join(predicted, "customer_id")


@REG.query(f"""WITH o AS (SELECT customer_id, order_ts, total_spend::DOUBLE AS a FROM order_aggregations WHERE customer_id IS NOT NULL AND order_ts IS NOT NULL AND total_spend IS NOT NULL),
f AS (SELECT (lo + to_months(12 + 3 * k))::DATE AS train_end, (lo + to_months(15 + 3 * k))::DATE AS test_end FROM (SELECT min(order_ts)::DATE AS lo, max(order_ts)::DATE AS hi FROM o), (SELECT unnest(range(0, 400))::INTEGER AS k) WHERE (lo + to_months(15 + 3 * k))::DATE <= hi),
m AS (SELECT train_end, test_end, customer_id, avg(a) AS p FROM f JOIN o ON order_ts < train_end GROUP BY 1, 2, 3), r AS (SELECT train_end, test_end, a, p FROM m JOIN o USING (customer_id) WHERE order_ts >= train_end AND order_ts <= test_end)
SELECT train_end::VARCHAR AS train_end, test_end::VARCHAR AS test_end, {_TWO.format('avg(abs(a - p))', 2)} AS mae, {_TWO.format('coalesce(avg(abs((a - p) / a)) FILTER (WHERE a <> 0) * 100, 0)', 2)} AS mape, {_TWO.format('sqrt(avg((a - p) * (a - p)))', 2)} AS rmse, {_TWO.format('coalesce(abs(sum(a) - sum(p)) / nullif(sum(a), 0) * 100, 0)', 2)} AS arpe,
 {_TWO.format('CASE WHEN var_pop(a) > 0 THEN 1 - avg((a - p) * (a - p)) / var_pop(a) ELSE 0 END', 4)} AS r_squared, count(*) AS sample_size FROM r GROUP BY 1, 2""")
def agg_cv(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "order_aggregations").filter("customer_id is not null and order_ts is not null and total_spend is not null")

    def pipeline(train: DataFrame, test: DataFrame) -> DataFrame:
        mean = train.groupBy("customer_id").agg(F.avg(F.col("total_spend").cast("double")).alias("predicted"))
        return test.select("customer_id", F.col("total_spend").alias("actual")).join(mean, "customer_id")

    rows = [(str(a), str(b), *m) for a, b, m in qu.cross_validate(t, "order_ts", pipeline)]
    return spark.createDataFrame(rows, "train_end string, test_end string, mae decimal(18,2), mape decimal(18,2), rmse decimal(18,2), arpe decimal(18,2), r_squared decimal(18,4), sample_size bigint")


# ---------------------------------------------------------------- experiments


def _mod_sql(text: str, m: int) -> str:
    base = 2**32 % m
    words = [f"('0x' || substr(md5({text}), {1 + 8 * i}, 8))::BIGINT" for i in range(4)]
    r = f"({words[0]} % {m})"
    for w in words[1:]:
        r = f"(({r} * {base} + {w}) % {m})"
    return r


@REG.query(f"SELECT customer_id, CASE WHEN b <= 50 THEN 'control' WHEN b <= 80 THEN 'treatment' END AS variant FROM (SELECT DISTINCT customer_id, {_mod_sql(chr(39) + 'exp:' + chr(39) + ' || customer_id', 10000)} / 100.0 AS b FROM customer_identifiers WHERE customer_id IS NOT NULL)")
def ab_assign(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer_identifiers").filter("customer_id is not null").select("customer_id").distinct()
    return users.withColumn("variant", ex.assign("exp", F.col("customer_id"), {"control": 50.0, "treatment": 30.0}))


@REG.query(f"SELECT customer_id, CASE WHEN b < 40 THEN 'a' WHEN b < 70 THEN 'b' ELSE 'a' END AS variant FROM (SELECT DISTINCT customer_id, {_mod_sql(chr(39) + 'ml:' + chr(39) + ' || customer_id', 100)} AS b FROM customer_identifiers WHERE customer_id IS NOT NULL)")
def ab_assign_ml(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer_identifiers").filter("customer_id is not null").select("customer_id").distinct()
    return users.withColumn("variant", ex.assign_modulo("ml", F.col("customer_id"), {"a": 40, "b": 30}, "a"))


@REG.query(f"SELECT customer_id, CASE WHEN b < 85 THEN 'a' WHEN b < 100 THEN 'b' ELSE 'a' END AS variant FROM (SELECT DISTINCT customer_id, {_mod_sql(chr(39) + 'ml:' + chr(39) + ' || customer_id', 100)} AS b FROM customer_identifiers WHERE customer_id IS NOT NULL)")
def ab_assign_gradual(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer_identifiers").filter("customer_id is not null").select("customer_id").distinct()
    return users.withColumn("variant", ex.assign_modulo("ml", F.col("customer_id"), ex.gradual({"a": 70, "b": 30}, "a", 0.5), "a"))


_SEGMENTS = "u AS (SELECT c_custkey, c_custkey::VARCHAR AS user_id, c_mktsegment AS segment, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey END AS nation FROM customer)"


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey")).alias("nation"))


@REG.query(f"WITH {_SEGMENTS} SELECT user_id FROM u WHERE segment = 'BUILDING' AND coalesce(nation <> 5, true)")
def flt_eligibility(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d)
    return u.filter(ex.eligible(set(u.columns), {"segment": "BUILDING", "absent": 1}, {"nation": 5})).select("user_id")


RULES = [ex.Rule({"user_ids": ["1", "2", "3"]}, "named", 10), ex.Rule({"attr_segment": "MACHINERY"}, "machines", 5), ex.Rule({"nation": 7}, "seven", 1), ex.Rule({"attr_absent": 1}, "never", 99)]
_TARGET = "CASE WHEN user_id IN ('1', '2', '3') THEN 'named' WHEN segment = 'MACHINERY' THEN 'machines' WHEN coalesce(nation = 7, true) THEN 'seven' END"


@REG.query(f"WITH {_SEGMENTS} SELECT user_id, {_TARGET} AS value FROM u")
def flt_targeting(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d)
    return u.select("user_id", ex.targeting(RULES, set(u.columns)).alias("value"))


_FLAG_TEST, _FLAG_ROLL = (_mod_sql(t, 10000) + " / 100.0" for t in ("'new_ui:' || user_id || ':t1'", "'new_ui:' || user_id"))


@REG.query(f"WITH {_SEGMENTS} SELECT user_id, coalesce({_TARGET}, CASE WHEN {_FLAG_TEST} <= 20 THEN 'A' WHEN {_FLAG_TEST} <= 40 THEN 'B' END, CASE WHEN {_FLAG_ROLL} <= 25 THEN 'on' END, 'off') AS value FROM u")
def ab_flag(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d)
    return u.select("user_id", ex.flag("new_ui", RULES, set(u.columns), test=("t1", {"x": 20.0, "y": 20.0}, {"x": "A", "y": "B"}), rollout=25.0).alias("value"))


@REG.query("SELECT event_type AS variant, count(*) AS n, round(avg(coalesce(value, 1)), 6) AS mean, round(stddev_samp(coalesce(value, 1)), 6) AS std, round(median(coalesce(value, 1)), 6) AS median, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_ab(spark: SparkSession, d: str) -> DataFrame:
    return ex.variant_stats(table(spark, d, "events"), "event_type", F.col("value"), "user_id").withColumns({c: F.round(c, 6) for c in ("mean", "std", "median")})


def _dict_rows(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame([(k, None if isinstance(v, str) else float(v), v if isinstance(v, str) else None) for k, v in values.items()], "name string, number double, text string").withColumn("number", F.round("number", 6))


def _named_sql(source: str, **values: str) -> str:
    """Rows (name, number, text) of the values of one row; a value in apostrophes is a text."""
    return " UNION ALL ".join(f"SELECT '{k}' AS name, {'NULL::DOUBLE' if v.startswith('text:') else f'round(({v})::DOUBLE, 6)'} AS number, {v[5:] if v.startswith('text:') else 'NULL::VARCHAR'} AS text FROM {source}" for k, v in values.items())


def _integral(density: str, upper: str) -> str:
    """The integral of a density in u from 0 to ``upper`` by Simpson's rule over 4,000 steps."""
    return f"(SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density})) * ({upper}) / 12000 FROM (SELECT i, i * ({upper}) / 4000.0 AS u FROM range(0, 4001) g(i)))"


_BELL = "exp(-u * u / 2) / sqrt(2 * pi())"
_TWO_GROUPS = """g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE value IS NOT NULL AND event_type IN ('view', 'click') GROUP BY 1),
s AS (SELECT a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb, b.m - a.m AS diff, a.v / a.n + b.v / b.n AS e2, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM g a, g b WHERE a.event_type = 'view' AND b.event_type = 'click')"""
#: Fixed value: the normal quantile of 0.975.
_Z = "1.959963984540054"
_T975 = f"({_Z} + (power({_Z}, 3) + {_Z}) / (4 * df) + (5 * power({_Z}, 5) + 16 * power({_Z}, 3) + 3 * {_Z}) / (96 * df * df) + (3 * power({_Z}, 7) + 19 * power({_Z}, 5) + 17 * power({_Z}, 3) - 15 * {_Z}) / (384 * power(df, 3)))"


@REG.query(f"""WITH {_TWO_GROUPS}, t AS (SELECT *, diff / sqrt(e2) AS t, e2 * e2 / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS df, diff / sqrt(pooled) AS d FROM s),
p AS (SELECT *, 1 - 2 * {_integral("exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * power(1 + u * u / df, -(df + 1) / 2)", "abs(t)")} AS p, {_T975} * sqrt(e2) AS half FROM t)
{_named_sql("p", statistic="t", p_value="p", df="df", effect_size="d", hedges_g="d * (1 - 3 / (4.0 * (na + nb) - 9))", low="diff - half", high="diff + half")}""")
def st_ttest(spark: SparkSession, d: str) -> DataFrame:
    m = ex.moments(table(spark, d, "events"), "event_type", "value")
    return _dict_rows(spark, ex.t_test(m["view"], m["click"]))


@REG.query(f"""WITH c AS (SELECT value AS x, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) AS k FROM events WHERE value IS NOT NULL AND event_type IN ('view', 'click') GROUP BY 1),
r AS (SELECT *, coalesce(sum(k) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0::DOUBLE AS rank FROM c), q AS (SELECT sum(a)::DOUBLE AS n1, sum(k)::DOUBLE AS n, sum(a * rank) AS r1, sum(power(k::DOUBLE, 3) - k) AS ties FROM r),
u AS (SELECT n1, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u, n1 * (n - n1) / 2 AS mean, n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1))) AS var FROM q), z AS (SELECT *, greatest((abs(u - mean) - 0.5) / sqrt(var), 0) AS z FROM u),
p AS (SELECT *, 1 - 2 * {_integral(_BELL, "z")} AS p FROM z) {_named_sql("p", statistic="u", p_value="least(p, 1)", effect_size="1 - 2 * u / (n1 * n2)")}""")
def st_mwu(spark: SparkSession, d: str) -> DataFrame:
    return _dict_rows(spark, ex.mann_whitney(table(spark, d, "events"), "event_type", "value", "view", "click"))


@REG.query(f"""WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 10)::DOUBLE AS x, count(value)::DOUBLE AS n FROM events GROUP BY 1), s AS (SELECT a.x / a.n AS p1, b.x / b.n AS p2, (a.x + b.x) / (a.n + b.n) AS p, 1 / a.n + 1 / b.n AS w FROM g a, g b WHERE a.event_type = 'view' AND b.event_type = 'click'),
z AS (SELECT *, sqrt(p * (1 - p) * w) AS se, (p2 - p1) / sqrt(p * (1 - p) * w) AS z FROM s), p AS (SELECT *, 1 - 2 * {_integral(_BELL, "abs(z)")} AS tail FROM z)
{_named_sql("p", statistic="z", p_value="tail", effect_size="p2 - p1", low=f"p2 - p1 - {_Z} * se", high=f"p2 - p1 + {_Z} * se")}""")
def st_prop(spark: SparkSession, d: str) -> DataFrame:
    n = {r["event_type"]: (r["hits"], r["n"]) for r in table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("hits"), F.count("value").alias("n")).collect()}
    return _dict_rows(spark, ex.proportions(*n["view"], *n["click"]))


@REG.query(f"""WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*)::DOUBLE AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY r) AS nr, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS total FROM c),
x AS (SELECT any_value(total) AS total, any_value(total) * (sum(n * n / (nr * nc)) - 1) AS chi, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS df, least(count(DISTINCT r), count(DISTINCT c)) - 1 AS k FROM t)
{_named_sql("x", statistic="chi", p_value="CASE df WHEN 2 THEN exp(-chi / 2) END", df="df", effect_size="sqrt(chi / (total * k))")}""")
def st_chi2(spark: SparkSession, d: str) -> DataFrame:
    return _dict_rows(spark, ex.chi2_contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@REG.query(f"""WITH {_TWO_GROUPS}, q AS (SELECT diff / sqrt(e2) AS z, 0.5 / sqrt(2) AS theta, 2 / (1.0 / na + 1.0 / nb) AS n FROM s), x AS (SELECT z * sqrt(n * theta * theta / 2) AS now, n * theta * theta / 2 AS information, ln(0.8 / 0.05) / theta AS upper, ln(0.2 / 0.95) / theta AS lower FROM q)
{_named_sql("x", decision="text:CASE WHEN now >= upper THEN 'reject_h0' WHEN now <= lower THEN 'accept_h0' ELSE 'continue' END", statistic="now", upper="upper", lower="lower", information="information")}""")
def st_seq(spark: SparkSession, d: str) -> DataFrame:
    m = ex.moments(table(spark, d, "events"), "event_type", "value")
    return _dict_rows(spark, ex.sequential(m["view"], m["click"]))


@REG.query(f"""WITH {_TWO_GROUPS}, q AS (SELECT diff, sqrt(e2) AS sd, diff / sqrt(e2) AS z, abs((0.1 - diff) / sqrt(e2)) AS z1, abs((-0.1 - diff) / sqrt(e2)) AS z2 FROM s),
x AS (SELECT *, 0.5 + sign(z) * {_integral(_BELL, "abs(z)")} AS better, exp(-z * z / 2) / sqrt(2 * pi()) AS density, sign(0.1 - diff) * {_integral(_BELL, "z1")} - sign(-0.1 - diff) * {_integral(_BELL, "z2")} AS rope FROM q)
{_named_sql("x", prob_b_better="better", loss_a="diff * better + sd * density", loss_b="-diff * (1 - better) + sd * density", prob_in_rope="rope")}""")
def st_bayes(spark: SparkSession, d: str) -> DataFrame:
    m = ex.moments(table(spark, d, "events"), "event_type", "value")
    return _dict_rows(spark, ex.bayes_normal(m["view"], m["click"], 0.1))


@REG.query()
def st_power(spark: SparkSession, d: str) -> DataFrame:
    n = ex.sample_size(0.2)
    return _dict_rows(spark, {"sample_size": n, "power": ex.power_of(n, 0.2), "smallest_effect": ex.smallest_effect(n), "hedges": ex.hedges(0.5, 40)})


@REG.query("""WITH t AS (SELECT 'u' || (user_id % 12) AS n, power(round(avg(value), 6) / 100, 6) AS p FROM events GROUP BY 1), r AS (SELECT n AS name, p, row_number() OVER (ORDER BY p, n) AS k, count(*) OVER () AS m FROM t), h AS (SELECT sum(1.0::DOUBLE / i) AS h FROM r, range(1, 13) g(i) WHERE k = i)
SELECT 'bonferroni' AS method, name, round(least(p * m, 1), 9) AS adjusted FROM r UNION ALL SELECT 'holm', name, round(least(max(p * (m - k + 1)) OVER (ORDER BY k), 1), 9) FROM r UNION ALL SELECT 'fdr_bh', name, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 9) FROM r
UNION ALL SELECT 'fdr_by', name, round(least(min(p * m / k * h) OVER (ORDER BY k DESC), 1), 9) FROM r, h UNION ALL SELECT 'sidak', name, round(least(1 - power(1 - p, m), 1), 9) FROM r""")
def st_mcc(spark: SparkSession, d: str) -> DataFrame:
    """Twelve p-values made from the means of the events of a twelfth of the users each."""
    name = F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string"))
    p = table(spark, d, "events").groupBy(name.alias("name")).agg(F.pow(F.round(F.avg("value"), 6) / 100, F.lit(6)).alias("p_value"))
    out = None
    for m in ("bonferroni", "holm", "fdr_bh", "fdr_by", "sidak"):
        part = ex.adjust(p, m).select(F.lit(m).alias("method"), "name", F.round("adjusted", 9).alias("adjusted"))
        out = part if out is None else out.union(part)
    return out


@REG.query(f"""WITH {_TWO_GROUPS}, x AS (SELECT *, (SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) FROM events) AS days, (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) AS least, abs(diff / sqrt(e2)) AS t FROM s)
SELECT CASE WHEN least < 100 THEN false WHEN days >= 60 OR t > {_Z} THEN true ELSE false END AS stop, CASE WHEN least < 100 THEN 'too few samples' WHEN days >= 60 THEN 'time is up' WHEN t > {_Z} THEN 'significant' ELSE 'go on' END AS reason FROM x""")
def ab_stop(spark: SparkSession, d: str) -> DataFrame:
    """Whether an experiment on the events' kinds may stop: by its size, its days, and the test of views against clicks."""
    events = table(spark, d, "events")
    m = ex.moments(events, "event_type", "value")
    days = events.select(F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts")))).first()[0] or 0
    return ex.stopping(ex.variant_stats(events, "event_type", F.col("value")), min_n=100, max_days=60, days=days, p_value=ex.t_test(m["view"], m["click"])["p_value"])


# ---------------------------------------------------------------- feature store

AT = "TIMESTAMP '2023-09-01'"
_NAMES = ["loyalty_tier", "credit_band", "account_status"]


def at() -> Column:
    return F.lit("2023-09-01").cast("timestamp_ntz")


@REG.query(f"SELECT entity_id, {', '.join(f'max(CASE WHEN feature_name = {chr(39)}{f}{chr(39)} THEN value END) AS {f}' for f in _NAMES)} FROM (SELECT DISTINCT customer_id AS entity_id FROM scoring_labels WHERE customer_id IS NOT NULL) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY created_at DESC, value_id) AS k FROM feature_values WHERE valid_from <= {AT} AND (valid_until IS NULL OR {AT} < valid_until)) WHERE k = 1) USING (entity_id) GROUP BY 1")
def jn_feature_asof(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "scoring_labels").filter("customer_id is not null").select(F.col("customer_id").alias("entity_id")).distinct()
    return fs.read_asof(wanted, table(spark, d, "feature_values"), _NAMES, at())


_LATEST = f"l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_name, entity_id ORDER BY created_at DESC, value_id DESC) AS k FROM feature_values WHERE created_at <= {AT}) WHERE k = 1)"


@REG.query(f"WITH {_LATEST} SELECT feature_name, entity_id, value_id FROM l")
def win_latest(spark: SparkSession, d: str) -> DataFrame:
    return fs.read_latest(table(spark, d, "feature_values"), at()).select("feature_name", "entity_id", "value_id")


@REG.query(f"WITH {_LATEST}, f(feature_name, dv) AS (VALUES ('loyalty_tier', '\"basic\"'), ('credit_band', NULL), ('account_status', '0')) SELECT e.entity_id, f.feature_name, coalesce(l.value, CASE WHEN dv NOT IN ('', '0', '0.0', 'false', '\"\"') THEN dv END) AS value FROM (SELECT DISTINCT customer_id AS entity_id FROM scoring_labels WHERE customer_id IS NOT NULL) e, f LEFT JOIN l ON l.entity_id = e.entity_id AND l.feature_name = f.feature_name")
def jn_feature_ts(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "scoring_labels").filter("customer_id is not null").select(F.col("customer_id").alias("entity_id")).distinct()
    definitions = spark.createDataFrame([("loyalty_tier", '"basic"'), ("credit_band", None), ("account_status", "0")], "feature_name string, default_value string")
    return fs.serve(wanted, definitions, fs.read_latest(table(spark, d, "feature_values"), at()))


@REG.query(f"SELECT feature_name, count(*) AS n, count(DISTINCT entity_id) AS entities, count(*) FILTER (WHERE created_at > {AT} - INTERVAL 1 DAY AND created_at <= {AT}) AS recent FROM feature_values GROUP BY 1")
def agg_fs_stats(spark: SparkSession, d: str) -> DataFrame:
    return fs.store_stats(table(spark, d, "feature_values"), at())


@REG.query("SELECT value_id, 'not allowed' AS violation FROM feature_values WHERE feature_name = 'account_status' AND value IS NOT NULL AND value <> 'null' AND trim(value, '\"') NOT IN ('active', 'dormant')")
def fs_validate(spark: SparkSession, d: str) -> DataFrame:
    return fs.violations(table(spark, d, "feature_values"), {"account_status": {"type": "STRING", "allowed": ("active", "dormant")}})


@REG.query("SELECT event_id, round(value * 0.7 + 9, 6) AS popularity, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.3 END::DOUBLE AS affinity, round((value * 0.7 + 9) * CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.3 END, 6) AS score FROM events")
def fs_realtime(spark: SparkSession, d: str) -> DataFrame:
    computers = {
        "score": (("popularity", "affinity"), F.round(F.col("popularity") * F.col("affinity"), 6)), "popularity": (("value",), F.round(fs.popularity(F.col("value"), F.lit(3)), 6)),
        "affinity": (("event_type",), fs.affinity(F.col("event_type"), F.lit("view"))),
    }
    return fs.compute(table(spark, d, "events"), computers).select("event_id", "popularity", "affinity", "score")


# ---------------------------------------------------------------- lineage: parts feed suppliers feed nations feed regions

_EDGES = """edges AS (SELECT DISTINCT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier UNION SELECT DISTINCT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT DISTINCT 's' || l_suppkey, 'b' || (l_partkey % 50) FROM lineitem)"""
_WALK = "w AS (SELECT 'r1' AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM w JOIN edges ON src = node WHERE distance < 10)"


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, n, lines = (table(spark, d, t) for t in ("supplier", "nation", "lineitem"))
    parts = [s.select(text("n", "s_nationkey").alias("src"), text("s", "s_suppkey").alias("dst")), n.select(text("r", "n_regionkey").alias("src"), text("n", "n_nationkey").alias("dst")), lines.select(text("s", "l_suppkey").alias("src"), F.concat(F.lit("b"), (F.col("l_partkey") % 50).cast("string")).alias("dst"))]
    edges = parts[0].union(parts[1]).union(parts[2]).distinct()
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.when(F.col("id").startswith("b"), "model").otherwise("dataset"))
    return vertices, edges


def one(spark: SparkSession, node: str) -> DataFrame:
    return spark.createDataFrame([(node,)], "id string")


@REG.query(f"WITH RECURSIVE {_EDGES}, {_WALK} SELECT node, min(distance)::INTEGER AS distance FROM w WHERE distance > 0 GROUP BY 1")
def gr_downstream(spark: SparkSession, d: str) -> DataFrame:
    return li.reach(graph(spark, d)[1], one(spark, "r1")).select("node", "distance")


@REG.query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT 'b7' AS node, 0 AS distance UNION SELECT src, distance + 1 FROM w JOIN edges ON dst = node WHERE distance < 10) SELECT node, min(distance)::INTEGER AS distance FROM w WHERE distance > 0 GROUP BY 1")
def gr_upstream(spark: SparkSession, d: str) -> DataFrame:
    return li.reach(graph(spark, d)[1], one(spark, "b7"), upstream=True).select("node", "distance")


@REG.query(f"WITH {_EDGES}, p AS (SELECT min('r1>' || a.dst || '>' || b.dst || '>' || c.dst) AS path FROM edges a JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst WHERE a.src = 'r1' AND c.dst = 'b7') SELECT len(string_split(path, '>'))::INTEGER AS nodes FROM p")
def gr_path(spark: SparkSession, d: str) -> DataFrame:
    path = li.shortest_path(graph(spark, d)[1], "r1", "b7")
    return spark.createDataFrame([(len(path),)], "nodes int")


@REG.query(f"WITH RECURSIVE {_EDGES}, {_WALK}, x AS (SELECT DISTINCT node FROM w WHERE distance > 0) SELECT 'r1' AS root, count(*) AS downstream, count(*) FILTER (WHERE node LIKE 'b%') AS models, count(*) + 2 * count(*) FILTER (WHERE node LIKE 'b%') AS risk_score, CASE WHEN risk_score >= 20 THEN 'critical' WHEN risk_score >= 10 THEN 'high' WHEN risk_score >= 5 THEN 'medium' ELSE 'low' END AS risk FROM x")
def gr_impact(spark: SparkSession, d: str) -> DataFrame:
    return li.impact(*graph(spark, d), one(spark, "r1"))


@REG.query(f"WITH {_EDGES}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT src, dst, m AS missing FROM (SELECT src, dst, unnest([src, dst]) AS m FROM edges) WHERE m NOT IN (SELECT id FROM v WHERE id NOT IN ('n3', 'b5'))")
def gr_integrity(spark: SparkSession, d: str) -> DataFrame:
    v, e = graph(spark, d)
    return li.dangling(v.filter("id not in ('n3', 'b5')"), e)


@REG.query("SELECT 'x' AS id UNION ALL SELECT 'y' UNION ALL SELECT 'z'")
def gr_cycles(spark: SparkSession, d: str) -> DataFrame:
    return li.on_cycles(spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "q")], "src string, dst string"))


@REG.query(f"WITH RECURSIVE {_EDGES}, {_WALK}, x AS (SELECT DISTINCT node FROM w WHERE distance <= 2) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM x) AND dst IN (SELECT node FROM x)")
def gr_feature(spark: SparkSession, d: str) -> DataFrame:
    return li.subgraph(graph(spark, d)[1], one(spark, "r1"), 2, "down")


@REG.query(f"WITH {_EDGES} SELECT DISTINCT s_suppkey FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT src FROM edges) AND 's' || s_suppkey NOT IN (SELECT dst FROM edges)")
def gr_orphans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return li.orphans(s, graph(spark, d)[1]).select("s_suppkey")


# ---------------------------------------------------------------- run tables, over the events as runs

_RUNS = "runs AS (SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS duration_s, CASE WHEN event_type = 'error' THEN 'Timeout while loading partition ' || (user_id % 7) END AS error FROM events)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.when(bad, "failed").otherwise("success").alias("status"), F.col("value").alias("duration_s"), F.when(bad, F.concat(F.lit("Timeout while loading partition "), (F.col("user_id") % 7).cast("string"))).alias("error"))


@REG.query(f"WITH {_RUNS} SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS succeeded, round(count(*) FILTER (WHERE status = 'success') * 100.0 / count(*), 4)::DOUBLE AS success_rate, round(avg(duration_s), 4) AS avg_duration, min(duration_s) AS min_duration, max(duration_s) AS max_duration FROM runs")
def agg_wf(spark: SparkSession, d: str) -> DataFrame:
    return wf.run_stats(runs(spark, d))


@REG.query(f"WITH {_RUNS} SELECT error, count(*) AS count FROM runs WHERE error IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg_wf_errors(spark: SparkSession, d: str) -> DataFrame:
    return wf.top_errors(runs(spark, d))


for _unit, _n in (("HOUR", 24), ("DAY", 7)):
    REG.query(f"WITH {_RUNS}, g AS (SELECT unnest(generate_series(date_trunc('{_unit}', TIMESTAMP '2024-02-01 12:30:00')::TIMESTAMP - INTERVAL {_n - 1} {_unit}, date_trunc('{_unit}', TIMESTAMP '2024-02-01 12:30:00')::TIMESTAMP, INTERVAL 1 {_unit})) AS bucket) SELECT bucket, count(id) AS runs, count(*) FILTER (WHERE status <> 'success') AS failures FROM g LEFT JOIN runs ON date_trunc('{_unit}', ts)::TIMESTAMP = bucket GROUP BY 1", name=f"agg_wf_{_unit.lower()}s")(
        lambda spark, d, unit=_unit, n=_n: wf.buckets(runs(spark, d), "ts", F.lit("2024-02-01 12:30:00").cast("timestamp_ntz"), n, unit)
    )


@REG.query(f"WITH {_RUNS}, l AS (SELECT * FROM runs WHERE error IS NOT NULL ORDER BY ts DESC LIMIT 50) SELECT 'Timeout loading partition' AS pattern, count(*) AS count FROM l HAVING count(*) >= 3")
def cls_wf_recurring(spark: SparkSession, d: str) -> DataFrame:
    return wf.recurring(runs(spark, d), "ts")


@REG.query("SELECT event_type AS key, count(*) FILTER (WHERE user_id % 3 = 0) AS r0, count(*) FILTER (WHERE user_id % 3 = 1) AS r1, count(*) FILTER (WHERE user_id % 3 = 2) AS r2 FROM events GROUP BY 1")
def agg_run_compare(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("run")).agg(F.count(F.lit(1)).alias("value"))
    return wf.compare_runs(values, ["r0", "r1", "r2"])


@REG.query("SELECT name, count(*) AS executions, round(count(*) FILTER (WHERE ok) * 100.0 / count(*), 4)::DOUBLE AS success_rate, round(avg(ms), 4) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM (SELECT event_type AS name, value AS ms, value < 50 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000 GROUP BY 1")
def agg_exec_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("name"), F.col("value").alias("ms"), (F.col("value") < 50).alias("ok"))
    return wf.last_executions(e)


@REG.query("SELECT count(*) AS artifacts, count(DISTINCT user_id) AS versions, sum(event_id)::BIGINT AS bytes, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20') AS last_day FROM events")
def agg_wf_storage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("version"), F.col("event_id").alias("bytes"), "ts")
    return wf.storage_stats(e, F.lit("2024-01-20").cast("timestamp_ntz"))


@REG.query("WITH v AS (SELECT list_sort(list(value)) AS l, count(value) AS n FROM events WHERE value IS NOT NULL), p AS (SELECT *, 0.95::DOUBLE * (n + 1) AS place, greatest(least(floor(0.95::DOUBLE * (n + 1))::BIGINT, n - 1), 1) AS low FROM v) SELECT round(l[low] + (l[low + 1] - l[low]) * (place - low), 6) AS p95, l[ceil(0.99::DOUBLE * n)::BIGINT] AS p99 FROM p")
def agg_latency(spark: SparkSession, d: str) -> DataFrame:
    return wf.latency(table(spark, d, "events"), "value").withColumn("p95", F.round("p95", 6))


@REG.query("SELECT round(100 - 0.4 * 5 - 0.2 * 5 - 3 - 0 - 0.1 * 15, 6)::DOUBLE AS score")
def cls_wf_health(spark: SparkSession, d: str) -> DataFrame:
    n = lambda v: F.lit(float(v))
    return spark.range(1).select(F.round(wf.health(n(90), n(10), n(3), F.lit(5), n(80)), 6).alias("score"))
