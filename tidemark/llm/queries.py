"""Queries of the operators for language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import distinct as nd
from tidemark.llm import percentiles as pc
from tidemark.llm import tokens as tk
from tidemark.llm.leaks import leak_spans, leaks, without_leaks, without_spans
from tidemark.llm.sentences import sentences
from tidemark.operators.trailing import current_periods
from tidemark.registry import Registry
from tidemark.session import table

REG = Registry()
PROBS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
GROUP = ["granularity", "period_start", "city", "source_system"]


def _periods(spark: SparkSession, d: str, *cells: str) -> DataFrame:
    return current_periods(table(spark, d, "period_aggregations"), ("loaded_at", *cells))


_CURRENT = """cur AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY loaded_at DESC) AS k FROM period_aggregations) WHERE k = 1)"""


def _percentile_sql(keys: str, where: str, select: str) -> str:
    return f"""
WITH {_CURRENT},
base AS (SELECT {select}, total_spend AS v FROM cur WHERE total_spend IS NOT NULL AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM base),
p AS (SELECT unnest([{", ".join(f"{q}::DECIMAL(10,9)" for q in PROBS)}]) AS q)
SELECT {keys}, n, q::DOUBLE AS q, v AS value FROM r, p WHERE rn = greatest(ceil(q * n), 1)"""


@REG.query(_percentile_sql("granularity, period_start, city, source_system", "true", "granularity, period_start, city, source_system"))
def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of total_spend per granularity, period, city and source; exact."""
    counts = pc.value_counts(_periods(spark, d, *GROUP, "total_spend"), GROUP, F.col("total_spend"))
    return pc.percentiles(counts, GROUP, PROBS)


@REG.query(_percentile_sql("month", "granularity = 'day'", "date_trunc('month', period_start)::TIMESTAMP AS month"))
def p4_percentiles_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of longer spans from the value counts of single days, cities and sources."""
    daily = pc.value_counts(_periods(spark, d, *GROUP, "total_spend"), GROUP[1:], F.col("total_spend"), "granularity = 'day'")
    spans = pc.merge_counts(daily.withColumn("month", F.date_trunc("month", "period_start").cast("timestamp_ntz")), ["month"])
    return pc.percentiles(spans, ["month"], PROBS)


@REG.query()
def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customers per granularity and every combination of period, city and source, from merged bit matrices."""
    base = nd.sketch(_periods(spark, d, *GROUP, "customer_id"), GROUP, "customer_id")
    return nd.estimate(nd.cube(base, ["granularity"], GROUP[1:]), ["granularity", "level", *GROUP[1:]])


@REG.query()
def p5_distinct_spans(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customers of calendar months, merged from the matrices of single days."""
    days = nd.sketch(_periods(spark, d, "granularity", "period_start", "customer_id").filter("granularity = 'day'"), ["period_start"], "customer_id")
    months = nd.merge(days.withColumn("month", F.date_trunc("month", "period_start").cast("timestamp_ntz")), ["month"])
    return nd.estimate(months, ["month"])


@REG.query(f"""
WITH {_CURRENT}
SELECT granularity, GROUPING(period_start, city, source_system)::INTEGER AS level, period_start, city, source_system, count(DISTINCT customer_id) AS n_exact, true AS within
FROM cur WHERE customer_id IS NOT NULL GROUP BY granularity, CUBE (period_start, city, source_system)""")
def p5_distinct_within(spark: SparkSession, d: str) -> DataFrame:
    """The exact counts of the groups of p5_distinct, and whether they lie within five standard errors of the estimates."""
    periods = _periods(spark, d, *GROUP, "customer_id").filter("customer_id is not null")
    dims = ["granularity", "level", *GROUP[1:]]
    near = nd.estimate(nd.cube(nd.sketch(periods, GROUP, "customer_id"), ["granularity"], GROUP[1:]), dims, z=5.0)
    exact = periods.cube(*GROUP).agg(F.grouping_id().alias("g"), F.count_distinct("customer_id").alias("n_exact")).filter("g < 8").withColumn("level", F.col("g").cast("int"))
    same = [exact[c].eqNullSafe(near[c]) for c in dims]
    inside = (exact["n_exact"] >= F.floor(near["lower"])) & (exact["n_exact"] <= F.ceil(near["upper"]))
    return exact.join(near, same).select(*[exact[c] for c in dims], "n_exact", inside.alias("within"))


@REG.query()
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tk.encode(table(spark, d, "documents"))


@REG.query()
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and texts that decoding doesn't give back (0), by language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    back = tk.encode(docs).select("doc_id", F.size("ids").alias("n"), tk.decode(F.col("ids"), tk.Vocabulary()).alias("back"))
    same = F.col("back") == F.coalesce("text", F.lit(""))
    return docs.join(back, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.count_if(~same).alias("not_restored"))


@REG.query("SELECT lang, count(*) AS documents, 0::BIGINT AS not_restored FROM documents GROUP BY 1")
def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """By language, the documents that decoding doesn't give back: none."""
    return p6_round_trip(spark, d).drop("tokens")


@REG.query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences(table(spark, d, "documents"))


@REG.query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an evaluation item."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@REG.query()
def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that are left when those of p7_found are removed."""
    return without_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items")).select("doc_id")


@REG.query()
def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the leaked passages lie in the documents."""
    return leak_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


@REG.query()
def p7_cut(spark: SparkSession, d: str) -> DataFrame:
    """Every document without its leaked passages."""
    return without_spans(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))
