"""Customer contract and acquisition cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Label pattern and months of each kind of cohort.
KINDS = {"month": 1, "quarter": 3, "year": 12}


def contract_violations(rows: DataFrame, now: Column) -> DataFrame:
    """(customer_id, violation): required fields missing, acquisition before 1970 or after ``now``, customer not visible."""
    ts = F.col("acquisition_ts")
    rules = {"customer_id missing": F.col("customer_id").isNull() | (F.col("customer_id") == ""), "acquisition_ts missing": ts.isNull(), "source_system missing": F.col("source_system").isNull() | (F.col("source_system") == ""), "acquisition_ts before 1970": ts < F.lit("1970-01-01").cast("timestamp_ntz"), "acquisition_ts in the future": ts > now, "not visible": ~F.coalesce("is_visible", F.lit(True))}
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda r: r.isNotNull())
    return rows.select("customer_id", F.explode(names).alias("violation"))


def merge_identifiers(rows: DataFrame) -> DataFrame:
    """One row per customer: earliest acquisition, visible if any row is (null counts as visible), the first source and
    the merged metadata, later rows winning. Rows are ordered by acquisition, then source; a null time comes last."""
    order = F.struct(F.col("acquisition_ts").isNull().alias("late"), "acquisition_ts", F.coalesce("source_system", F.lit("")).alias("source_system"))
    entries = F.array_sort(F.collect_set(F.struct(order.alias("o"), F.to_json("metadata").alias("m"))))
    grouped = rows.filter("customer_id is not null").groupBy("customer_id").agg(F.min("acquisition_ts").alias("acquisition_ts"), F.bool_or(F.coalesce("is_visible", F.lit(True))).alias("is_visible"), F.min_by("source_system", order).alias("source_system"), entries.alias("entries"))
    return grouped.select("customer_id", "acquisition_ts", "source_system", "is_visible", merged_of(F.col("entries")).alias("metadata"))


def merged_of(entries: Column) -> Column:
    maps = F.transform(entries, lambda e: F.coalesce(F.from_json(e["m"], "map<string,string>"), F.create_map().cast("map<string,string>")))
    return F.aggregate(maps, F.create_map().cast("map<string,string>"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(m, k)), m))


def generate_cohorts(low: Column, high: Column, one_row: DataFrame, kind: str = "month") -> DataFrame:
    """Contiguous [start_date, end_date) cohorts that cover low..high. ``one_row`` has the bounds; a start inside a period
    makes a short first cohort."""
    months = KINDS[kind]
    step = F.make_interval(months=F.lit(months))
    starts = F.explode(F.sequence(F.date_trunc(kind, low), F.date_trunc(kind, high), step)).alias("p")
    rows = one_row.select(low.alias("low"), starts)
    label = {"month": F.date_format("p", "yyyy-MM"), "quarter": F.concat(F.year("p"), F.lit("-Q"), F.quarter("p")), "year": F.date_format("p", "yyyy")}[kind]
    return rows.select(label.alias("cohort_id"), F.greatest(F.col("p").cast("timestamp_ntz"), F.col("low").cast("timestamp_ntz")).alias("start_date"), (F.col("p") + step).cast("timestamp_ntz").alias("end_date"))


def assign_cohorts(customers: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(customer_id, cohort_id) of the first definition, by ``ord`` or else start and id, whose [start, end) holds the
    acquisition. The range becomes an equi-join: each definition brings a row for each of its days."""
    ordered = cohorts if "ord" in cohorts.columns else cohorts.withColumn("ord", F.struct("start_date", "cohort_id"))
    days = F.explode(F.sequence(F.to_date("start_date"), F.to_date("end_date"))).alias("__day")
    by_day = ordered.filter("start_date < end_date").select("cohort_id", "start_date", "end_date", "ord", days)
    inside = (F.col("acquisition_ts") >= F.col("start_date")) & (F.col("acquisition_ts") < F.col("end_date"))
    dated = customers.filter("acquisition_ts is not null").withColumn("__day", F.to_date("acquisition_ts"))
    return dated.join(by_day, "__day").filter(inside).groupBy("customer_id").agg(F.min_by("cohort_id", "ord").alias("cohort_id"))


def coverage(customers: DataFrame, assignments: DataFrame) -> DataFrame:
    flags = customers.select("customer_id").distinct().join(assignments, "customer_id", "left")
    return flags.agg(F.count(F.lit(1)).alias("customers"), F.count("cohort_id").alias("assigned"), F.count_if(F.col("cohort_id").isNull()).alias("unassigned"))


def overlaps(cohorts: DataFrame) -> DataFrame:
    """Pairs of neighbours, by start, of which the later starts before the earlier ends. Touching is allowed."""
    w = Window.orderBy("start_date", "cohort_id")
    return cohorts.select("cohort_id", "end_date", F.lead("cohort_id").over(w).alias("next_id"), F.lead("start_date").over(w).alias("next_start")).filter("next_start < end_date").select("cohort_id", "next_id")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
