"""The five views of a customer base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rows import attach
from tidemark.operators.ordered import quantile_row, quantiles, sums_before

MONEY = "decimal(18,2)"


def pct(part: Column, whole: Column, scale: int = 2) -> Column:
    """Per cent, rounded HALF_UP; 0 of nothing."""
    return F.when(whole != 0, F.round(part.cast("decimal(28,10)") / whole.cast("decimal(28,10)") * 100, scale)).otherwise(F.lit(0)).cast("decimal(18,2)")


# ---------------------------------------------------------------- lens 1


def pareto(rows: DataFrame, percents: tuple[int, ...] = (10, 20)) -> DataFrame:
    """(percent, revenue_share): revenue share of the top p % of customers (at least one). Percents are 1 to 100.

    Ranks come from value counts in ranges, not from one sorted partition: customers with equal spend are one row.
    """
    if any(not 1 <= p <= 100 for p in percents):
        raise ValueError("percents must lie in 1..100")
    counts = rows.groupBy(F.col("total_spend").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum(F.col("v") * F.col("n")).alias("all_v"))
    ranked = attach(sums_before(counts.filter("v is not null"), "v", ["n"], descending=True).withColumnRenamed("n_before", "before"), total)
    wanted = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    limit = F.greatest(F.floor(F.col("all_n") * F.col("percent") / 100), F.lit(1))
    taken = F.greatest(F.least(F.col("n"), limit - F.col("before")), F.lit(0))
    shares = ranked.select("*", wanted).groupBy("percent").agg(F.sum(F.col("v") * taken).alias("top"), F.first("all_v").alias("all_v"))
    return shares.select("percent", pct(F.col("top"), F.col("all_v")).alias("revenue_share"))


def lens1(rows: DataFrame) -> DataFrame:
    """One row: customers, one-time buyers, orders, revenue, shares and medians of a single period; zeros without customers."""
    money = lambda c: F.coalesce(F.round(c, 2), F.lit(0)).cast(MONEY)
    one = F.count_if(F.col("frequency") == 1)
    base = rows.agg(
        F.count(F.lit(1)).alias("total_customers"), one.alias("one_time_buyers"), pct(one, F.count(F.lit(1))).alias("one_time_buyer_pct"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_orders"),
        money(F.sum("total_spend")).alias("total_revenue"), money(F.sum("frequency").cast("decimal(28,10)") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("avg_orders_per_customer"),
    )
    middle = quantile_row(rows, {"m": F.col("total_spend")}, [0.5]).select(money(F.col("q_m")[0].cast("decimal(28,4)")).alias("median_customer_value"))
    shares = pareto(rows).agg(*[F.coalesce(F.max(F.when(F.col("percent") == p, F.col("revenue_share"))), F.lit(0)).cast(MONEY).alias(f"top_{p}pct_revenue_share") for p in (10, 20)])
    return attach(base, middle, shares)


# ---------------------------------------------------------------- lens 2


def migration(first: DataFrame, second: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(customer_id, status): retained, churned or new; who is in the history but not in the first period is also reactivated."""
    a, b = first.select("customer_id").distinct().withColumn("p1", F.lit(True)), second.select("customer_id").distinct().withColumn("p2", F.lit(True))
    both = a.join(b, "customer_id", "full_outer")
    status = F.when(F.col("p1") & F.col("p2"), "retained").when(F.col("p1"), "churned").otherwise("new")
    out = both.select("customer_id", status.alias("status"))
    if history is not None:
        seen = history.select("customer_id").distinct()
        out = out.union(out.filter("status = 'new'").join(seen, "customer_id", "left_semi").withColumn("status", F.lit("reactivated")))
    return out


def history_gaps(first: DataFrame, history: DataFrame) -> DataFrame:
    """Customers of the first period that the history lacks; must be empty."""
    return first.select("customer_id").distinct().join(history.select("customer_id"), "customer_id", "left_anti")


def lens2(first: DataFrame, second: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row of rates and changes between two periods. A zero base gives 100 for growth and 0 for none."""
    moved = migration(first, second, history).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("retained", "churned", "new", "reactivated")])
    sums = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"customers_{n}"), F.coalesce(F.sum("total_spend"), F.lit(0)).alias(f"revenue_{n}"), F.coalesce(F.sum("frequency"), F.lit(0)).alias(f"orders_{n}"))
    row = attach(moved, sums(first, 1), sums(second, 2))
    aov = lambda n: F.when(F.col(f"orders_{n}") > 0, F.round(F.col(f"revenue_{n}").cast("decimal(28,10)") / F.col(f"orders_{n}"), 10)).otherwise(F.lit(0)).cast("decimal(28,10)")
    change = lambda a, b: F.when(a != 0, F.round((b - a).cast("decimal(28,10)") / a.cast("decimal(28,10)") * 100, 2)).when(b > 0, F.lit(100)).otherwise(F.lit(0)).cast(MONEY)
    c = F.col
    return row.select(
        "retained", "churned", "new", "reactivated", pct(c("retained"), c("customers_1")).alias("retention_rate"), pct(c("churned"), c("customers_1")).alias("churn_rate"), pct(c("reactivated"), c("customers_2")).alias("reactivation_rate"),
        (c("customers_2") - c("customers_1")).alias("customer_count_change"), change(c("revenue_1"), c("revenue_2")).alias("revenue_change_pct"), change(aov(1), aov(2)).alias("aov_change_pct"),
    )


# ---------------------------------------------------------------- lens 3


def lens3(periods: DataFrame, assignments: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Evolution of all cohorts in one grouped query: a row per cohort and observed period at or after its start.

    period_number is a dense rank over the cohort's observed periods, so gaps collapse. Rates per member divide by the
    number of assigned customers. A cohort's acquisition time is its start_date.
    """
    size = assignments.groupBy("cohort_id").agg(F.count_distinct("customer_id").alias("cohort_size"))
    rows = periods.join(assignments, "customer_id").join(cohorts.select("cohort_id", "start_date"), "cohort_id").filter(F.col("period_start") >= F.col("start_date"))
    first = Window.partitionBy("cohort_id", "customer_id").orderBy("period_start")
    seen = rows.withColumn("is_first", F.when(F.row_number().over(first) == 1, 1).otherwise(0))
    per = seen.groupBy("cohort_id", "period_start").agg(F.count_distinct("customer_id").alias("active_customers"), F.sum("is_first").alias("newly"), F.sum("total_orders").alias("orders"), F.sum("total_spend").alias("revenue"))
    order = Window.partitionBy("cohort_id").orderBy("period_start")
    c, d = F.col, lambda a, b: F.round(a.cast("double") / b, 6)
    run = F.sum("newly").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return per.join(size, "cohort_id").select(
        "cohort_id", (F.dense_rank().over(order) - 1).cast("bigint").alias("period_number"), "period_start", "active_customers", "cohort_size", d(run, c("cohort_size")).alias("cumulative_activation_rate"),
        d(c("orders"), c("active_customers")).alias("orders_per_active"), d(c("orders"), c("cohort_size")).alias("orders_per_member"), d(c("revenue"), c("active_customers")).alias("revenue_per_active"),
        d(c("revenue"), c("cohort_size")).alias("revenue_per_member"), c("revenue").cast(MONEY).alias("total_revenue"),
    )


def activation_curve(lens3_rows: DataFrame) -> DataFrame:
    return lens3_rows.select("cohort_id", "period_number", "cumulative_activation_rate")


# ---------------------------------------------------------------- lens 4


def decomposition(periods: DataFrame, assignments: DataFrame, *, aligned: str = "left", margin: bool = True) -> DataFrame:
    """Revenue of a cohort at a period index from already rounded factors: size, % active, orders per active, order value, margin.

    ``left``: the n-th active period of each customer; ``time``: the index of the period among all observed ones.
    """
    rows = periods.join(assignments, "customer_id")
    if aligned == "left":
        rows = rows.withColumn("period_number", F.row_number().over(Window.partitionBy("customer_id").orderBy("period_start")).cast("bigint") - 1)
    else:  # the calendar of observed periods: as many rows as periods, not customers
        calendar = periods.select("period_start").distinct().withColumn("period_number", F.row_number().over(Window.orderBy("period_start")).cast("bigint") - 1)
        rows = rows.join(calendar, "period_start")
    size = assignments.groupBy("cohort_id").agg(F.count_distinct("customer_id").alias("cohort_size"))
    sums = rows.groupBy("cohort_id", "period_number").agg(F.count(F.lit(1)).alias("active_customers"), F.sum("total_orders").alias("orders"), F.sum("total_spend").alias("spend"), F.sum("total_margin").alias("margin")).join(size, "cohort_id")
    c, wide = F.col, "decimal(28,10)"
    ratio = lambda a, b: F.when(b != 0, F.round(a.cast(wide) / b.cast(wide), 2)).otherwise(F.lit(0)).cast(MONEY)
    share = F.when(c("spend") != 0, F.round(c("margin").cast(wide) / c("spend").cast(wide) * 100, 2)).otherwise(F.lit(0)).cast(MONEY) if margin else F.lit(100).cast(MONEY)
    out = sums.withColumns({"pct_active": pct(c("active_customers"), c("cohort_size")), "aof": ratio(c("orders"), c("active_customers")), "aov": ratio(c("spend"), c("orders")), "margin_pct": share})
    # factors of few digits: the whole product fits 38 digits, and one division by 10,000 is a shift of the point
    revenue = c("cohort_size").cast("decimal(11,0)") * c("pct_active").cast("decimal(5,2)") * c("aof").cast("decimal(8,2)") * c("aov").cast("decimal(12,2)") * c("margin_pct").cast("decimal(8,2)") * F.lit("0.0001").cast("decimal(4,4)")
    return out.select("cohort_id", "period_number", "cohort_size", "active_customers", "pct_active", "aof", "aov", "margin_pct", F.round(revenue.cast("decimal(38,6)"), 2).cast(MONEY).alias("total_revenue"))


def time_to_second(periods: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per cohort: repeat customers and rate, median and mean days from the first to the second active period."""
    w = Window.partitionBy("cohort_id", "customer_id").orderBy("period_start")
    rows = periods.join(assignments, "customer_id").select("cohort_id", "customer_id", "period_start", F.row_number().over(w).alias("k"), F.lead("period_start").over(w).alias("next"))
    gap = rows.filter("k = 1 and next is not null").select("cohort_id", F.date_diff("next", "period_start").alias("days"))
    size = assignments.groupBy("cohort_id").agg(F.count_distinct("customer_id").alias("cohort_size"))
    per = gap.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("repeat_customers"), F.avg("days").alias("mean_days"))
    per = per.join(quantiles(gap, {"days": F.col("days")}, [0.5], ["cohort_id"]).select("cohort_id", F.col("q")[0].alias("median_days")), "cohort_id")
    return size.join(per, "cohort_id", "left").select("cohort_id", "cohort_size", F.coalesce("repeat_customers", F.lit(0)).alias("repeat_customers"), pct(F.coalesce("repeat_customers", F.lit(0)), F.col("cohort_size")).alias("repeat_rate"), F.round("median_days", 2).alias("median_days"), F.round("mean_days", 2).alias("mean_days"))


def cumulative_repeat(periods: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cohort_id, k, rate): % of the cohort with more than k + 1 active periods. It falls with k, despite its name."""
    n = periods.join(assignments, "customer_id").groupBy("cohort_id", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    size = assignments.groupBy("cohort_id").agg(F.count_distinct("customer_id").alias("cohort_size"))
    by_n = n.groupBy("cohort_id", "n").agg(F.count(F.lit(1)).alias("m"))  # no more rows than periods
    each = by_n.select("cohort_id", "m", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    return each.groupBy("cohort_id", "k").agg(F.sum(F.when(F.col("n") > F.col("k") + 1, F.col("m")).otherwise(0)).alias("m")).join(size, "cohort_id").select("cohort_id", "k", pct(F.col("m"), F.col("cohort_size")).alias("rate"))


def compare_cohorts(decomposed: DataFrame) -> DataFrame:
    """Each cohort against the one before it (by id) at the same period index: deltas as they are, changes in % to 2 places."""
    w = Window.partitionBy("period_number").orderBy("cohort_id")
    per_customer = F.round(F.col("total_revenue").cast("decimal(28,10)") / F.col("cohort_size"), 6)
    rows = decomposed.withColumn("revenue", per_customer)
    measures = ("pct_active", "aof", "aov", "revenue")
    pairs = rows.select("*", F.lead("cohort_id").over(w).alias("cohort_b"), *[F.lead(m).over(w).alias(f"{m}_b") for m in measures]).filter("cohort_b is not null")
    out = []
    for m in measures:
        a, b = F.col(m), F.col(f"{m}_b")
        change = F.when(a != 0, F.round((b - a).cast("decimal(28,10)") / a.cast("decimal(28,10)") * 100, 2)).when(b > 0, F.lit(100)).otherwise(F.lit(0)).cast(MONEY)
        out += [(b - a).cast("decimal(18,6)").alias(f"{m}_delta"), change.alias(f"{m}_change_pct")]
    return pairs.select(F.col("cohort_id").alias("cohort_a"), "cohort_b", "period_number", *out)


def cohort_totals(decomposed: DataFrame) -> DataFrame:
    """Per cohort: total and average period revenue, best first."""
    return decomposed.groupBy("cohort_id").agg(F.sum("total_revenue").cast(MONEY).alias("total_revenue"), F.round(F.avg("total_revenue").cast("double"), 2).alias("avg_revenue"), F.count(F.lit(1)).alias("periods"), F.max_by("period_number", F.struct("total_revenue", -F.col("period_number"))).alias("best_period"))


# ---------------------------------------------------------------- lens 5


def revenue_by_cohort(periods: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cohort x period revenue, its share of the period's assigned revenue, active customers, revenue per active."""
    rows = periods.join(assignments, "customer_id").groupBy("period_start", "cohort_id").agg(F.sum("total_spend").alias("revenue"), F.count_distinct("customer_id").alias("active_customers"))
    total = F.sum("revenue").over(Window.partitionBy("period_start"))
    return rows.select("period_start", "cohort_id", F.col("revenue").cast(MONEY).alias("revenue"), F.round(F.when(total != 0, F.col("revenue").cast("double") / total.cast("double") * 100).otherwise(0.0), 4).alias("pct_of_period"), "active_customers", F.round(F.col("revenue").cast("double") / F.col("active_customers"), 4).alias("revenue_per_active"))


def repeat_behaviour(periods: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per cohort, over all periods: buyers, one-time and repeat buyers, repeat rate. Customers without orders aren't counted."""
    orders = periods.groupBy("customer_id").agg(F.sum("total_orders").alias("orders"))
    rows = assignments.join(orders, "customer_id", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    buyers, repeat = F.count_if(F.col("orders") > 0), F.count_if(F.col("orders") > 1)
    return rows.groupBy("cohort_id").agg(buyers.alias("cohort_size"), F.count_if(F.col("orders") == 1).alias("one_time_buyers"), repeat.alias("repeat_buyers"), pct(repeat, buyers).alias("repeat_rate"), F.round(F.try_divide(F.sum("orders").cast("double"), buyers.cast("double")), 4).alias("avg_orders"))


def health(periods: DataFrame, assignments: DataFrame, order: Column | None = None) -> DataFrame:
    """One row: retention, repeat trend, predictability, dependence on the newest cohort, score and grade.

    Retention counts assigned customers only, so it can't exceed 100. The newest cohort is the last by id, or by ``order``,
    a column of the assignments such as the cohort's start.
    """
    by = F.struct((order if order is not None else F.lit(0)).alias("o"), "cohort_id")
    newest = assignments.agg(F.max(by).alias("new"), F.min(by).alias("old"), F.count_distinct("customer_id").alias("assigned"))
    active = periods.join(assignments.select("customer_id").distinct(), "customer_id", "left_semi").agg(F.count_distinct("customer_id").alias("active"))
    revenue = periods.join(assignments, "customer_id").groupBy("cohort_id").agg(F.sum("total_spend").alias("revenue"))
    repeat = repeat_behaviour(periods, assignments).select("cohort_id", "repeat_rate", "cohort_size")
    sums = attach(revenue, newest).agg(F.sum("revenue").alias("total"), F.sum(F.when(F.col("cohort_id") == F.col("new.cohort_id"), F.col("revenue")).otherwise(0)).alias("newest_revenue"))
    rates = attach(repeat, newest).agg(F.max(F.when(F.col("cohort_id") == F.col("new.cohort_id"), F.col("repeat_rate"))).alias("new_rate"), F.max(F.when(F.col("cohort_id") == F.col("old.cohort_id"), F.col("repeat_rate"))).alias("old_rate"), F.count(F.lit(1)).alias("cohorts"))
    row = attach(newest, active, sums, rates)
    c = F.col
    ratio = c("new_rate").cast("double") / F.nullif(c("old_rate").cast("double"), F.lit(0.0))
    trend = F.when(c("cohorts") < 2, "stable").when(c("old_rate") == 0, F.when(c("new_rate") > 0, "improving").otherwise("stable")).when(ratio >= 1.1, "improving").when(ratio <= 0.9, "declining").otherwise("stable")
    dependence = pct(c("newest_revenue"), c("total"))
    out = row.select(pct(c("active"), c("assigned")).alias("retention_rate"), trend.alias("repeat_trend"), F.when(c("total") != 0, 100 - dependence).otherwise(0).cast(MONEY).alias("revenue_predictability_pct"), dependence.alias("acquisition_dependence_pct"))
    return out.withColumn("health_score", health_score(c("retention_rate"), c("repeat_trend"), c("revenue_predictability_pct"), c("acquisition_dependence_pct"))).withColumn("health_grade", health_grade(c("health_score")))


def health_score(retention: Column, trend: Column, predictability: Column, dependence: Column) -> Column:
    points = F.when(trend == "improving", 80).when(trend == "stable", 50).otherwise(20)
    tenth = lambda weight, value: value.cast("decimal(18,4)") * F.lit(weight).cast("decimal(3,2)")
    return F.round(tenth("0.30", retention) + tenth("0.30", points) + tenth("0.20", predictability) + tenth("0.20", 100 - dependence), 2).cast(MONEY)


def health_grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
