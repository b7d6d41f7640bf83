"""Recency, frequency and monetary value per customer, and their quantile scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import floor_days, quantile_bin
from tidemark.functions.rows import attach
from tidemark.operators.ordered import quantile_row

MONEY = "decimal(18,2)"


def rfm(periods: DataFrame, observation_end: Column) -> DataFrame:
    """One row per customer. Any last_transaction_ts beats the last period_end; recency is in whole elapsed days and
    negative for activity after ``observation_end``, which ``future_activity`` lists."""
    last = F.coalesce(F.max("last_transaction_ts"), F.max("period_end"))
    sums = periods.filter("customer_id is not null").groupBy("customer_id").agg(last.alias("last"), F.min("period_start").alias("observation_start"), F.sum("total_orders").alias("frequency"), F.round(F.sum("total_spend"), 2).cast(MONEY).alias("total_spend"))
    monetary = F.round(F.col("total_spend").cast("decimal(28,10)") / F.nullif(F.col("frequency"), F.lit(0)), 2).cast(MONEY)
    return sums.select("customer_id", floor_days(observation_end, F.col("last")).alias("recency_days"), "frequency", monetary.alias("monetary"), "total_spend", "observation_start", observation_end.alias("observation_end"))


def future_activity(rfm_rows: DataFrame) -> DataFrame:
    return rfm_rows.filter("recency_days < 0")


def rfm_scores(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Scores 1 to ``bins`` by value quantiles with duplicate edges dropped; recency reversed; a single distinct value scores 3.

    The quantiles come from counted values in ranges and go back as a single row.
    """
    parts = {"r": "recency_days", "f": "frequency", "m": "monetary"}
    fractions = sorted({k / q for q in range(2, bins + 1) for k in range(q + 1)})
    edges = quantile_row(rows, {s: F.col(c) for s, c in parts.items()}, fractions)

    def binned(s: str, value: Column) -> Column:
        n = F.least(F.col(f"d_{s}"), F.lit(bins))
        edges_of = lambda q: F.array(*[F.col(f"q_{s}")[fractions.index(k / q)] for k in range(q + 1)])
        chosen = edges_of(bins)
        for q in range(bins - 1, 1, -1):
            chosen = F.when(n == q, edges_of(q)).otherwise(chosen)
        return F.when(n > 1, quantile_bin(value, F.array_distinct(chosen)))

    out = attach(rows, edges).withColumns({f"b_{s}": binned(s, F.col(c).cast("double")) for s, c in parts.items()})
    top = binned("r", F.element_at("q_r", -1))  # the bin of the largest
    r = F.coalesce(top - F.col("b_r") + 1, F.lit(3)).cast("int")
    f, m = (F.coalesce(F.col(f"b_{s}") + 1, F.lit(3)).cast("int") for s in "fm")
    scored = out.withColumns({"r_score": r, "f_score": f, "m_score": m}).withColumn("rfm_score", F.concat("r_score", "f_score", "m_score"))
    return scored.select(*rows.columns, "r_score", "f_score", "m_score", "rfm_score")


def score_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rfm_score").agg(F.count(F.lit(1)).alias("customers"))
