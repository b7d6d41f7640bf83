"""Words for numbers: classifications and recommendations of the five views, chart data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def texts(*cases: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.filter(F.array(*[F.when(ok, F.lit(t)) for ok, t in cases]), lambda t: t.isNotNull())


def lens1_health() -> Column:
    one, top, avg = c("one_time_buyer_pct"), c("top_10pct_revenue_share"), c("avg_orders_per_customer")
    score = 100 - F.when(one > 70, 30).when(one > 50, 15).otherwise(0) - F.when(top > 80, 20).when(top > 60, 10).otherwise(0) + F.when(avg > 3, 10).otherwise(0)
    return F.greatest(F.least(score, F.lit(100)), F.lit(0))


def lens1_risk() -> Column:
    top = c("top_10pct_revenue_share")
    return F.when(top > 70, "high").when(top > 50, "medium").otherwise("low")


def lens1_recommendations() -> Column:
    return texts((c("one_time_buyer_pct") > 60, "Win a second order from one-time buyers"), (c("top_10pct_revenue_share") > 70, "Reduce the dependence on top customers"), (c("avg_orders_per_customer") < 2, "Raise the order frequency"))


def lens2_momentum() -> Column:
    """Either change above zero already counts as moderate, so nothing is ever called declining."""
    n, r = c("customer_count_change"), c("revenue_change_pct")
    return F.when((n > 0) & (r > 10), "strong").when((n > 0) | (r > 0), "moderate").otherwise("negative")


def lens2_drivers() -> Column:
    new_pct = F.try_divide(c("new") * F.lit(100.0), (c("retained") + c("new")).cast("double"))
    return texts((c("retention_rate") > 80, "high retention"), (c("retention_rate") < 50, "low retention"), (c("churn_rate") > 30, "high churn"), (new_pct > 30, "many new customers"), (c("revenue_change_pct") > 20, "revenue growth"), (c("revenue_change_pct") < -20, "revenue decline"))


def lens2_recommendations() -> Column:
    return texts((c("retention_rate") < 60, "Improve retention"), (c("churn_rate") > 40, "Find the causes of churn"), (c("customer_count_change") < 0, "Win more customers"), (c("revenue_change_pct") < -10, "Restore revenue"), ((c("retention_rate") > 70) & (c("customer_count_change") > 0) & (c("revenue_change_pct") > 5), "Keep the course"))


def lens3_labels(rows: DataFrame) -> DataFrame:
    """Per cohort: maturity, lifetime-value trend and recommendations from its evolution."""
    retention = F.col("active_customers") / F.col("cohort_size") * 100
    last3 = F.slice(F.sort_array(F.collect_list(F.struct("period_number", "r")), asc=False), 1, 3)  # as many elements as periods
    g = rows.withColumn("r", retention).groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("r", "period_number").alias("last_r"), F.sum("revenue_per_member").alias("ltv"), F.min_by("revenue_per_member", "period_number").alias("first_v"), F.max_by("revenue_per_member", "period_number").alias("last_v"),
        F.max(F.when(F.col("period_number") == 1, F.col("r"))).alias("r1"), F.avg("revenue_per_member").alias("mean_v"), (F.max("cumulative_activation_rate") * 100).alias("activation"), last3.alias("last3"),
    )
    maturity = F.when(c("n") <= 2, "early").when(c("n") <= 6, "growth").when(c("n") <= 12, "mature").when(c("last_r") < 10, "declining").otherwise("mature")
    ltv = F.when(c("n") < 2, "moderate").when(c("ltv") > 500, "strong").when((c("n") >= 3) & (c("last_v") > 0.5 * c("first_v")), "moderate").when(c("ltv") < 100, "weak").otherwise("moderate")
    advice = texts((c("r1") < 30, "Improve the first repeat"), (c("mean_v") < 50, "Raise revenue per member"), (c("activation") < 50, "Activate more of the cohort"), ((c("n") >= 3) & F.forall("last3", lambda s: s["r"] < 10), "Win the cohort back"))
    return g.select("cohort_id", maturity.alias("maturity"), ltv.alias("ltv_trend"), F.array_join(advice, "; ").alias("recommendations"))


def lens4_differences(cohorts: DataFrame) -> DataFrame:
    """One row of findings over cohorts (revenue_per_customer, frequency, aov, median_days)."""
    hi, lo = (lambda k: F.max(k)), (lambda k: F.min(k))
    spread = lambda k: F.try_divide((hi(k) - lo(k)).cast("double"), hi(k).cast("double"))
    row = cohorts.agg(spread("revenue_per_customer").alias("s_rev"), F.try_divide(hi("frequency").cast("double"), lo("frequency").cast("double")).alias("f"), spread("aov").alias("s_aov"), F.try_divide(hi("median_days").cast("double"), F.nullif(lo("median_days").cast("double"), F.lit(0.0))).alias("t"))
    return row.select(F.array_join(texts((c("s_rev") > 0.5, "revenue differs"), (c("f") > 1.5, "frequency differs"), (c("s_aov") > 0.3, "order value differs"), (c("t") > 1.5, "time to the second order differs")), "; ").alias("differences"))


def lens4_recommendations(cohorts: DataFrame) -> DataFrame:
    ratio = lambda k: F.try_divide(F.max(k).cast("double"), F.nullif(F.min(k).cast("double"), F.lit(0.0)))
    row = cohorts.agg(ratio("revenue_per_customer").alias("r"), ratio("frequency").alias("f"), ratio("aov").alias("a"), F.avg("mean_days").alias("t"))
    return row.select(F.array_join(texts((c("r") > 2, "Study what the best cohort bought"), (c("f") > 1.5, "Raise the frequency of weak cohorts"), (c("a") > 1.3, "Raise the order value of weak cohorts"), (c("t") > 60, "Shorten the time to the second order")), "; ").alias("recommendations"))


#: Thresholds of the fifth view.
STRONG_RETENTION, GOOD_RETENTION, ACCEPTABLE_RETENTION, CRITICAL_LOW_RETENTION = 80, 75, 70, 60
HIGH_PREDICTABILITY, MEDIUM_PREDICTABILITY, LOW_PREDICTABILITY = 70, 60, 50
LOW_ACQUISITION_DEPENDENCE, MEDIUM_ACQUISITION_DEPENDENCE, HIGH_ACQUISITION_DEPENDENCE = 20, 35, 40
STRONG_REPEAT_RATE, WEAK_REPEAT_RATE, HIGH_REPEAT_COHORTS_PROPORTION = 60, 30, 0.5


def lens5_texts() -> dict[str, Column]:
    r, p, d, t = c("retention_rate"), c("revenue_predictability_pct"), c("acquisition_dependence_pct"), c("repeat_trend")
    grade = c("health_grade")
    return {
        "assessment": F.when(grade == "A", "excellent").when(grade == "B", "good").when(grade == "C", "fair").when(grade == "D", "poor").otherwise("critical"),
        "strengths": F.array_join(texts((r >= STRONG_RETENTION, "strong retention"), ((r >= GOOD_RETENTION) & (r < STRONG_RETENTION), "good retention"), (t == "improving", "improving repeat trend"), (p >= HIGH_PREDICTABILITY, "predictable revenue"), (d <= LOW_ACQUISITION_DEPENDENCE, "low dependence on new customers")), "; "),
        "risks": F.array_join(texts((r < CRITICAL_LOW_RETENTION, "critically low retention"), ((r >= CRITICAL_LOW_RETENTION) & (r < ACCEPTABLE_RETENTION), "low retention"), (t == "declining", "declining repeat trend"), (p < LOW_PREDICTABILITY, "unpredictable revenue"), (d > HIGH_ACQUISITION_DEPENDENCE, "high dependence on new customers")), "; "),
        "recommendations": F.array_join(texts((r < ACCEPTABLE_RETENTION, "Invest in retention"), (t == "declining", "Study recent cohorts"), (p < MEDIUM_PREDICTABILITY, "Strengthen existing cohorts"), (d > MEDIUM_ACQUISITION_DEPENDENCE, "Balance acquisition with retention")), "; "),
    }


def model_drift_level(score: Column) -> Column:
    return F.when(score < 0.1, "low").when(score < 0.25, "medium").when(score < 0.5, "high").otherwise("critical")


def performance_level(baseline: Column, current: Column) -> Column:
    change = F.abs(F.try_divide((current - baseline).cast("double"), baseline.cast("double"))) * 100
    return F.when(change < 5, "none").when(change < 15, "low").when(change < 30, "medium").when(change.isNotNull(), "high")


#: Words that lead a question to a view.
ROUTES = {
    "lens1": ("rfm", "pareto", "concentration", "snapshot", "single period", "health"), "lens2": ("compare", "period", "churn", "migration", "retention"), "lens3": ("cohort", "evolution", "lifetime"),
    "lens4": ("compare cohorts", "cohort comparison", "which cohort"), "lens5": ("overall", "health score", "customer base health", "grade"),
}


def route(text: str) -> list[str]:
    """The views a question asks for, by words; the first if none. Words of the fifth view keep "health" from the first."""
    t = text.lower()
    hits = [lens for lens, words in ROUTES.items() if any(w in t for w in words)]
    if "lens5" in hits and "lens1" in hits and not any(w in t for w in ROUTES["lens1"] if w != "health"):
        hits.remove("lens1")
    return hits or ["lens1"]


# ---------------------------------------------------------------- chart data


def chart_retention(lens3_rows: DataFrame) -> DataFrame:
    return lens3_rows.select("cohort_id", "period_number", F.round(F.col("cumulative_activation_rate") * 100, 4).alias("rate_pct"), "active_customers")


def chart_pareto(lens1_row: DataFrame) -> DataFrame:
    t, u = c("top_10pct_revenue_share"), c("top_20pct_revenue_share")
    parts = F.explode(F.array(F.struct(F.lit("top 10%").alias("slice"), t.alias("share")), F.struct(F.lit("next 10%").alias("slice"), (u - t).cast("decimal(18,2)").alias("share")), F.struct(F.lit("the rest").alias("slice"), (100 - u).cast("decimal(18,2)").alias("share"))))
    return lens1_row.select(parts.alias("p")).select("p.*")


def chart_heatmap(decomposed: DataFrame, periods: list[int]) -> DataFrame:
    """Cohorts down, period numbers across, % active; missing cells null."""
    return decomposed.groupBy("cohort_id").pivot("period_number", periods).agg(F.first("pct_active"))


def chart_sankey(moved: DataFrame) -> DataFrame:
    """(source, target, customers); reactivated customers are taken out of the new ones, so inflows add up."""
    n = {s: F.count_if(F.col("status") == s) for s in ("retained", "churned", "new", "reactivated")}
    row = moved.agg(*[v.alias(k) for k, v in n.items()])
    flow = lambda a, b, v: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), v.alias("customers"))
    flows = [flow("Period 1", "Retained", c("retained")), flow("Retained", "Period 2", c("retained")), flow("Period 1", "Churned", c("churned")), flow("New", "Period 2", c("new") - c("reactivated")), flow("Reactivated", "Period 2", c("reactivated"))]
    return row.select(F.explode(F.array(*flows)).alias("f")).select("f.*")


# ---------------------------------------------------------------- text reports


def markdown_table(df: DataFrame, most: int = 500) -> str:
    """A small result as a Markdown table; more than ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if v is None else str(v) for v in cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *(line(r) for r in rows)]) + "\n"


def latest_of_cohorts(lens3_rows: DataFrame) -> DataFrame:
    """Each cohort's last observed period, by cohort."""
    cells = ["period_number", "period_start", "active_customers", "cohort_size", "cumulative_activation_rate", "revenue_per_member", "total_revenue"]
    return lens3_rows.groupBy("cohort_id").agg(F.max(F.struct(*cells)).alias("r")).select("cohort_id", "r.*").orderBy("cohort_id")


def audit_report(parts: dict[str, DataFrame]) -> str:
    """The views' summaries as one Markdown text."""
    return "# Customer-base audit\n\n" + "\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts.items())


def health_summary(row: dict) -> str:
    return f"The customer base grades {row['health_grade']} with a score of {row['health_score']}. Retention is {row['retention_rate']} %, the repeat trend {row['repeat_trend']}, and {row['acquisition_dependence_pct']} % of revenue comes from the newest cohort."


