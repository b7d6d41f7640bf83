"""Data-quality expectations, profiles and validation metrics."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import floor_days
from tidemark.functions.rows import attach
from tidemark.operators.ordered import quantile_row, quantiles
from tidemark.session import stored

# ---------------------------------------------------------------- expectations


@dataclass(frozen=True)
class Expectation:
    """kind: row_count_between, column_exists, not_null, unique or columns_match_ordered."""

    kind: str
    column: str | None = None
    options: dict = field(default_factory=dict)


def run_suite(df: DataFrame, suite: list[Expectation]) -> DataFrame:
    """(kind, column, success, observed): all counts in one aggregate, uniqueness by one more per column.

    Unique counts repeated rows, n less the number of distinct values, nulls being equal to each other.
    """
    spark = df.sparkSession
    have = set(df.columns)
    aggregates = {"n": F.count(F.lit(1))}
    for i, e in enumerate(suite):
        if e.kind == "not_null" and e.column in have:
            aggregates[f"x{i}"] = F.count_if(F.col(e.column).isNull())
    facts = df.agg(*[c.alias(k) for k, c in aggregates.items()])
    for i, e in enumerate(suite):
        if e.kind == "unique" and e.column in have:
            repeated = df.groupBy(e.column).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias(f"x{i}"))
            facts = attach(facts, repeated)
    row = facts.first().asDict()
    out = []
    for i, e in enumerate(suite):
        if e.kind == "row_count_between":
            ok, seen = e.options.get("low", 0) <= row["n"] <= e.options.get("high", float("inf")), row["n"]
        elif e.kind == "column_exists":
            ok, seen = e.column in have, int(e.column in have)
        elif e.kind == "columns_match_ordered":
            ok, seen = df.columns == list(e.options["columns"]), len(df.columns)
        elif e.kind in ("not_null", "unique"):
            seen = row.get(f"x{i}", -1)
            ok = seen == 0
        else:
            raise ValueError(f"unknown expectation {e.kind!r}")
        out.append((e.kind, e.column or "", bool(ok), int(seen)))
    return spark.createDataFrame(out, "kind string, column string, success boolean, observed bigint")


def success_rate(results: DataFrame) -> DataFrame:
    """One row: number of checks, failures, rate from 0 to 1."""
    return results.agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("success")).alias("failures"), F.avg(F.col("success").cast("int")).alias("success_rate"))


def suggest(df: DataFrame, key: str | None = None) -> list[Expectation]:
    """A suite from a table: its columns in order, its row count as a floor, and not-null for columns without nulls."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"x{i}") for i, c in enumerate(df.columns)]).first()
    suite = [Expectation("columns_match_ordered", options={"columns": tuple(df.columns)}), Expectation("row_count_between", options={"low": 1, "high": max(1, 2 * row["n"])})]
    suite += [Expectation("not_null", c) for i, c in enumerate(df.columns) if row[f"x{i}"] == 0]
    return suite + ([Expectation("unique", key)] if key else [])


def alerts(results: DataFrame, rules: DataFrame, last_fired: DataFrame | None = None) -> DataFrame:
    """The rules that fire on a summary (success_rate, failures, failed kinds). Rules: rule, kind, threshold, cooldown_s,
    where kind is success_rate_below (threshold from 0 to 1), failures_above or expectation_failed (by name). A rule that
    fired within its cooldown (last_fired: rule, age_s) is silent."""
    facts = success_rate(results)
    failed = results.filter(~F.col("success")).select(F.col("kind").alias("name")).distinct()
    fired = attach(rules, facts).join(failed, F.col("rules_name").eqNullSafe(F.col("name")) if "rules_name" in rules.columns else F.lit(False), "left")
    hit = F.when(F.col("kind") == "success_rate_below", F.col("success_rate") < F.col("threshold")).when(F.col("kind") == "failures_above", F.col("failures") > F.col("threshold")).otherwise(F.col("name").isNotNull())
    out = fired.filter(hit).select("rule", "kind")
    if last_fired is not None:
        silent = rules.join(last_fired, "rule").filter("age_s < cooldown_s")
        out = out.join(silent.select("rule"), "rule", "left_anti")
    return out


# ---------------------------------------------------------------- profiles


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their share, repeated rows (n less distinct, nulls equal)."""
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    n = F.count(F.lit(1))
    base = df.agg(n.alias("row_count"), F.lit(len(df.columns)).alias("column_count"), cells.alias("missing_cells"), F.round(F.try_divide(cells.cast("double"), n.cast("double") * len(df.columns)) * 100, 6).alias("missing_pct"))
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_rows"))
    return attach(base, distinct)


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column; skewness and kurtosis are bias-corrected, outliers lie 1.5 interquartile ranges outside."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")
    rows = df.select(pairs).select("p.column", "p.x")
    x, n = F.col("x"), F.count("x").cast("double")
    g1, g2 = F.skewness("x"), F.kurtosis("x")
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    stats = rows.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.var_samp("x").alias("variance"), skew.alias("skewness"), kurt.alias("kurtosis"), F.count_if(x == 0).alias("zeros_count"), F.count_if(x < 0).alias("negative_count"))
    found = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75]).select(F.col("metric").alias("column"), "q")
    stats = stored(stats.join(found, "column", "left"))  # a row per column
    limits = stats.select("column", (F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("lo"), (F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("hi"))
    out = rows.join(F.broadcast(limits), "column").groupBy("column").agg(F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("outliers_count"))
    qs = [F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")]
    return stats.join(out, "column").select("column", "n", "min", "max", "mean", *qs, "std", "variance", "skewness", "kurtosis", "zeros_count", "negative_count", "outliers_count", (F.col("outliers_count") / F.col("n") * 100).alias("outliers_percentage"))


def profile_text(df: DataFrame, column: str) -> DataFrame:
    """One row of text lengths; a null counts as a text of three characters, as it would print."""
    n = F.length(F.coalesce(F.col(column).cast("string"), F.lit("nan")))
    return df.agg(F.max(n).alias("max_length"), F.min(n).alias("min_length"), F.avg(n).alias("avg_length"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column).limit(n)


def profile_datetime(df: DataFrame, column: str) -> DataFrame:
    lo, hi = F.min(column), F.max(column)
    days = floor_days(hi, lo).cast("bigint")
    return df.agg(lo.alias("min"), hi.alias("max"), days.alias("range_days"))


def correlations(df: DataFrame, columns: list[str], strong: float | None = None) -> DataFrame:
    """(column1, column2, correlation) over rows where both are present; with ``strong`` only |r| at least that."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    safe = lambda c: F.col(c).cast("double")
    row = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), safe(a)), F.when(F.col(a).isNotNull(), safe(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
    return out.filter(F.abs("correlation") >= strong) if strong is not None else out


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two profile rows and warnings: row count off by over 10 %, missing share up by over 5 points."""
    a, b = before.select(*[F.col(c).alias(f"a_{c}") for c in before.columns]), after.select(*[F.col(c).alias(f"b_{c}") for c in after.columns])
    d = lambda c: (F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_change")
    warn = F.filter(F.array(F.when(F.abs(F.col("b_row_count") - F.col("a_row_count")) > 0.1 * F.col("a_row_count"), F.lit("row count changed")), F.when(F.col("b_missing_pct") - F.col("a_missing_pct") > 5, F.lit("more missing values"))), lambda w: w.isNotNull())
    return attach(a, b).select(d("row_count"), d("column_count"), d("missing_pct"), d("duplicate_rows"), F.array_join(warn, "; ").alias("warnings"))


def model_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean share of missing values and of outliers (quartile fences), and the mean of their complements."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    fences = quantile_row(df, {c: F.col(c) for c in numeric}, [0.25, 0.75]).select(*[f"q_{c}" for c in numeric]) if numeric else None
    rows = df if fences is None else attach(df, fences)

    def outlier(c: str) -> Column:
        lo, hi = F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]
        return (F.col(c) < lo - 1.5 * (hi - lo)) | (F.col(c) > hi + 1.5 * (hi - lo))

    n = F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0))  # null shares of an empty table
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) / n for c in columns]) / len(columns)
    outliers = reduce(lambda a, b: a + b, [F.count_if(outlier(c)) / n for c in numeric]) / len(numeric) if numeric else F.lit(0.0)
    return rows.agg(F.count(F.lit(1)).alias("total_samples"), missing.alias("missing_share"), outliers.alias("outlier_share")).withColumn("overall_score", (2 - F.col("missing_share") - F.col("outlier_share")) / 2)


# ---------------------------------------------------------------- validation of predictions


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: mae, mape (non-zero actuals), rmse, arpe (against the sum of actuals), r2 (0 without variance), n; to 2 places,
    r2 to 4, half to even."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rows = df.filter(a.isNotNull() & p.isNotNull())
    sums = rows.agg(F.avg(F.abs(a - p)).alias("mae"), F.avg(F.when(a != 0, F.abs((a - p) / a))).alias("mape"), F.avg((a - p) * (a - p)).alias("mse"), F.sum(a).alias("sa"), F.sum(p).alias("sp"), F.var_pop(a).alias("va"), F.count(F.lit(1)).alias("sample_size"))
    two = lambda c, n=2: F.bround(c.cast("decimal(28,10)"), n).cast(f"decimal(18,{n})")
    c = F.col
    return sums.select(two(c("mae")).alias("mae"), two(F.coalesce(c("mape") * 100, F.lit(0.0))).alias("mape"), two(F.sqrt("mse")).alias("rmse"), two(F.coalesce(F.try_divide(F.abs(c("sa") - c("sp")), c("sa")) * 100, F.lit(0.0))).alias("arpe"), two(F.when(c("va") > 0, 1 - c("mse") / c("va")).otherwise(F.lit(0.0)), 4).alias("r_squared"), "sample_size")


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy and precision, recall and F1 weighted by the labels' counts."""
    rows = df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).select(F.col(label).alias("y"), F.col(predicted).alias("z"))
    cells = rows.groupBy("y", "z").agg(F.count(F.lit(1)).alias("n"))  # classes squared rows
    total = F.sum("n")
    true = cells.groupBy(F.col("y").alias("k")).agg(total.alias("support"), F.sum(F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("z").alias("k")).agg(total.alias("said"))
    per = true.join(said, "k", "left").withColumns({"precision": F.coalesce(F.col("hit") / F.col("said"), F.lit(0.0)), "recall": F.col("hit") / F.col("support")})
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), w("precision"), w("recall"), w("f1"))


def temporal_split(df: DataFrame, ts: str, train_end: Column, observation_end: Column) -> dict[str, DataFrame]:
    """train: before train_end; observation: up to observation_end; test: from train_end up to observation_end."""
    t = F.col(ts)
    return {"train": df.filter(t < train_end), "observation": df.filter(t <= observation_end), "test": df.filter((t >= train_end) & (t <= observation_end))}


def expanding_folds(df: DataFrame, ts: str, months: int = 12, step: int = 3) -> list[tuple]:
    """(train_end, test_end) of folds: the first train takes ``months``, each later one ``step`` more, while the test fits."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    out: list[tuple] = []
    while lo is not None and (test_end := _months_on(lo.date(), months + step * (len(out) + 1))) <= hi.date():
        out.append((_months_on(lo.date(), months + step * len(out)), test_end))
    return out


def _months_on(day: dt.date, n: int) -> dt.date:
    """So many months later, at most at the month's end."""
    year, month = divmod(day.year * 12 + day.month - 1 + n, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def cross_validate(df: DataFrame, ts: str, pipeline, months: int = 12, step: int = 3) -> list:
    """One row of metrics per fold; ``pipeline(train, test)`` gives a DataFrame of actual and predicted values."""
    out = []
    for train_end, test_end in expanding_folds(df, ts, months, step):
        day = lambda x: F.lit(x).cast("timestamp_ntz")
        parts = temporal_split(df, ts, day(train_end), day(test_end))
        out.append((train_end, test_end, regression_metrics(pipeline(parts["train"], parts["test"])).first()))
    return out
