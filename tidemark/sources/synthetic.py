"""Synthetic customers and transactions: distributions as configured, seeded by customer, made in parallel."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rows import attach


@dataclass(frozen=True)
class Scenario:
    seed: int = 42
    churn_hazard: float = 0.08
    base_orders_per_month: float = 1.2
    mean_unit_price: float = 30.0
    price_sigma: float = 0.4
    quantity_mean: float = 1.3
    promo_month: int | None = None
    promo_uplift: float = 1.5
    launch_month: int | None = None
    launch_uplift: float = 1.3


#: The presets and their seeds.
SCENARIOS = {
    "baseline": Scenario(42), "high_churn": Scenario(43, churn_hazard=0.25), "product_recall": Scenario(44, churn_hazard=0.15, base_orders_per_month=0.8), "heavy_promotion": Scenario(45, promo_month=6, promo_uplift=2.0),
    "product_launch": Scenario(46, launch_month=4, launch_uplift=1.6), "seasonal_business": Scenario(47, promo_month=12, promo_uplift=1.8), "stable_business": Scenario(48, churn_hazard=0.03),
}


def customers(spark: SparkSession, n: int, start: str, end: str, seed: int = 42) -> DataFrame:
    """C-1 to C-n with a uniform acquisition date in [start, end]."""
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    day = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), days).cast("int")
    return spark.range(1, n + 1).select(F.concat(F.lit("C-"), F.col("id").cast("string")).alias("customer_id"), F.date_add(F.lit(start).cast("date"), day).alias("acquisition_date"))


def allocate(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers that add up to the total, by largest remainder."""
    exact = {k: total * v / sum(shares.values()) for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def regional_client(spark: SparkSession, n: int = 1000, start: str = "2023-01-01", end: str = "2023-12-31", seed: int = 42) -> DataFrame:
    """Customers of a client in four cities, 35, 30, 20 and 15 %."""
    parts = allocate(n, {"Houston": 35, "Dallas": 30, "Austin": 20, "San Antonio": 15})
    city, low = None, 0
    number = F.regexp_extract("customer_id", r"(\d+)", 1).cast("int")
    for name, count in parts.items():
        low += count
        city = F.when(number <= low, name) if city is None else city.when(number <= low, name)
    return customers(spark, n, start, end, seed).withColumn("city", city)


TRANSACTIONS = "order_id string, customer_id string, event_ts timestamp_ntz, product_id string, quantity int, unit_price decimal(18,2)"


def transactions(people: DataFrame, start: str, end: str, scenario: Scenario = SCENARIOS["baseline"]) -> DataFrame:
    """Line items per customer and month until churn: Poisson orders (normal from a mean of 10), log-normal prices, 1 to 3
    lines an order. Each customer has a generator of its own, so the result doesn't depend on partitioning."""
    months = pd.period_range(start, end, freq="M")
    low, high = pd.Timestamp(start), pd.Timestamp(end) + pd.Timedelta(days=1)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for customer, acquired in zip(batch["customer_id"], pd.to_datetime(batch["acquisition_date"])):
                rng = np.random.default_rng([scenario.seed, zlib.crc32(customer.encode())])
                for month in months:
                    if month.end_time < acquired:
                        continue
                    if month.start_time > acquired and rng.random() < scenario.churn_hazard:
                        break
                    mean = scenario.base_orders_per_month * (scenario.promo_uplift if scenario.promo_month == month.month else 1) * (scenario.launch_uplift if scenario.launch_month and month.month >= scenario.launch_month else 1)
                    n = int(max(0, round(rng.normal(mean, mean**0.5)))) if mean >= 10 else int(rng.poisson(mean))
                    for k in range(n):
                        ts = (month.start_time + pd.Timedelta(seconds=int(rng.integers(0, month.days_in_month * 86400)))).floor("s")
                        if ts < max(low, acquired) or ts >= high:
                            continue
                        for _ in range(int(rng.integers(1, 4))):
                            price = float(np.round(scenario.mean_unit_price * np.exp(rng.normal(0, scenario.price_sigma) - scenario.price_sigma**2 / 2), 2))
                            rows.append((f"{customer}-{month}-{k}", customer, ts, f"SKU-{int(rng.integers(1, 21))}", 1 + int(rng.poisson(scenario.quantity_mean - 1)), price))
            out = pd.DataFrame(rows, columns=["order_id", "customer_id", "event_ts", "product_id", "quantity", "unit_price"])
            yield out.astype({"quantity": "int32"})

    made = people.select("customer_id", "acquisition_date").mapInPandas(make, TRANSACTIONS.replace("decimal(18,2)", "double"))
    return made.withColumn("unit_price", F.col("unit_price").cast("decimal(18,2)"))


def checks(lines: DataFrame, people: DataFrame, promo_month: int | None = None) -> DataFrame:
    """(check, ok, observed) over line items: amounts, density, promotion, spread, duplicates, coverage."""
    total = F.sum(F.col("quantity") * F.col("unit_price"))
    orders = lines.groupBy("order_id", "customer_id").agg(total.alias("spend"))
    facts = lines.agg(F.count_if((F.col("quantity") < 0) | (F.col("unit_price") < 0)).alias("negative"), (F.count_distinct("order_id") / F.greatest(F.count_distinct("customer_id"), F.lit(1))).alias("density"), F.count_distinct("customer_id").alias("active"))
    spread = orders.agg((F.stddev_samp("spend").cast("double") / F.avg("spend").cast("double")).alias("cv"))
    repeated = people.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count(F.lit(1)).alias("people"))
    row = attach(facts, spread, repeated).first()
    out = [("non_negative", row["negative"] == 0, float(row["negative"])), ("density", row["density"] >= 1, float(row["density"])), ("spend_cv", 0.1 <= (row["cv"] or 0) <= 5, float(row["cv"] or 0)), ("no_duplicates", row["repeated"] == 0, float(row["repeated"])), ("coverage", row["active"] >= 0.5 * row["people"], row["active"] / max(1, row["people"]))]
    if promo_month is not None:
        month = lines.groupBy(F.date_trunc("month", "event_ts").alias("m")).agg(F.count_distinct("order_id").alias("n"))
        s = month.agg(F.avg(F.when(F.month("m") == promo_month, F.col("n"))).alias("a"), F.avg(F.when(F.month("m") != promo_month, F.col("n"))).alias("b")).first()
        ratio = (s["a"] or 0) / (s["b"] or 1)
        out.append(("promo_spike", ratio >= 1.2, float(ratio)))
    return people.sparkSession.createDataFrame([(n, bool(ok), float(v)) for n, ok, v in out], "check string, ok boolean, observed double")


def decay(retention: DataFrame) -> DataFrame:
    """(cohort_id, period_number, ratio, ok): retention against the period before, at most twice as high."""
    ratio = F.try_divide(F.col("retention"), F.lag("retention").over(Window.partitionBy("cohort_id").orderBy("period_number")))
    return retention.withColumn("ratio", ratio).filter("ratio is not null").select("cohort_id", "period_number", "ratio", (F.col("ratio") <= 2).alias("ok"))
