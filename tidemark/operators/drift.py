"""Distribution drift: population stability index, Kolmogorov-Smirnov, chi-square, per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rows import attach
from tidemark.functions.tails import chi2_tail, kolmogorov_tail
from tidemark.operators.ordered import counted_quantiles, quantile_row, sums_before
from tidemark.session import stored


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, x) of several numeric columns; nulls and NaN are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")
    return df.select(pairs).select("p.metric", "p.x").filter("x is not null and not isnan(x)")


def _binned(values: DataFrame, e: Column, name: str) -> DataFrame:
    inside = values.filter((F.col("x") >= e[0]) & (F.col("x") <= F.element_at(e, -1)))
    bin_ = F.least(F.size(F.filter(e, lambda v: v <= F.col("x"))) - 1, F.size(e) - 2)
    return inside.groupBy("metric", bin_.alias("bin")).agg(F.count(F.lit(1)).alias(name))


def psi(baseline: DataFrame, current: DataFrame, bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """(metric, psi) of two long tables. Bins are the baseline's distinct percentiles, stretched to hold all values; empty
    bins count epsilon; a constant baseline gives 0. Metrics with fewer than ``bins`` values on a side give null."""
    side = lambda df, b, c: df.select("metric", "x", F.lit(b).alias("b"), F.lit(c).alias("c"))
    counts = stored(side(baseline, 1, 0).union(side(current, 0, 1)).groupBy("metric", "x").agg(F.sum("b").alias("b"), F.sum("c").alias("c")))  # both sides are read once
    weighed = counts.filter("b > 0").select(F.struct("metric").alias("g"), F.col("x").alias("v"), F.col("b").alias("k"))
    base = counted_quantiles(weighed, [k / bins for k in range(bins + 1)], []).select("metric", F.col("q").alias("p"), F.col("q")[0].alias("lo"), F.element_at("q", -1).alias("hi"), F.col("n").alias("n_base"))
    cur = counts.filter("c > 0").groupBy("metric").agg(F.min("x").alias("clo"), F.max("x").alias("chi"), F.sum("c").alias("n_cur"))
    both = base.join(cur, "metric")  # one row per metric
    distinct = F.array_distinct("p")
    inner = F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0)))
    edges = F.concat(F.array(F.least("lo", "clo") - epsilon), inner, F.array(F.greatest("hi", "chi") + epsilon))
    limits = stored(both.select("metric", "n_base", "n_cur", F.when(F.size(distinct) >= 2, edges).alias("edges")))
    usable = limits.filter("edges is not null").select("metric", "edges")
    grid = usable.select("metric", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    e = F.col("edges")
    bin_ = F.least(F.size(F.filter(e, lambda v: v <= F.col("x"))) - 1, F.size(e) - 2)  # right-open; the last bin holds its right edge
    filled = counts.join(F.broadcast(usable), "metric").groupBy("metric", bin_.alias("bin")).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    counts = grid.join(filled, ["metric", "bin"], "left").join(limits, "metric")
    share = lambda n, total: F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.lit(epsilon)).otherwise(F.col(n) / F.col(total))
    b, c = share("b", "n_base"), share("c", "n_cur")
    sums = counts.groupBy("metric").agg(F.sum((c - b) * F.ln(c / b)).alias("psi"))
    enough = (F.col("n_base") >= bins) & (F.col("n_cur") >= bins)
    return limits.join(sums, "metric", "left").select("metric", F.when(enough, F.coalesce("psi", F.lit(0.0))).alias("psi"))


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """(x, share): the share of values up to each value that occurs; nulls and NaN are left out."""
    value = F.col(x).cast("double")
    counts = df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("x")).agg(F.count(F.lit(1)).alias("k"))
    run = sums_before(counts, "x", ["k"])
    return attach(run, run.agg(F.sum("k").alias("n"))).select("x", ((F.col("k_before") + F.col("k")) / F.col("n")).alias("share"))


def ks_statistic(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """One row (d, n, m): the largest distance of two empirical distributions, over value counts."""
    side = lambda df, na, nb: df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(F.col(x).cast("double").alias("x"), F.lit(na).alias("a"), F.lit(nb).alias("b"))
    counts = stored(side(a, 1, 0).union(side(b, 0, 1)).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    totals = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    run = attach(sums_before(counts, "x", ["a", "b"]), totals)
    gap = F.abs(F.try_divide((F.col("a_before") + F.col("a")).cast("double"), F.col("n").cast("double")) - F.try_divide((F.col("b_before") + F.col("b")).cast("double"), F.col("m").cast("double")))
    return run.agg(F.max(gap).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))


def ks_test(a: DataFrame, b: DataFrame, x: str, alpha: float = 0.05) -> dict:
    row = ks_statistic(a, b, x).first()
    if row["d"] is None or not row["n"] or not row["m"]:
        raise ValueError("both samples need values")
    p = kolmogorov_tail(row["d"], row["n"], row["m"])
    return {"statistic": row["d"], "p_value": p, "drift": p < alpha}


#: What a score means.
def interpret_psi(score: Column) -> Column:
    return F.when(score < 0.1, "No significant drift").when(score < 0.25, "Small drift, investigation recommended").otherwise("Significant drift, retraining recommended")


def feature_drift(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, threshold: float = 0.2) -> DataFrame:
    """(metric, drift_score, drift_detected, threshold, interpretation) by PSI, all columns in one pass. Columns that a side
    lacks raise."""
    for side, df in (("baseline", baseline), ("current", current)):
        if lacking := set(columns) - set(df.columns):
            raise ValueError(f"{side} lacks {sorted(lacking)}")
    scores = psi(long_form(baseline, columns), long_form(current, columns), bins).filter("psi is not null")
    return scores.select("metric", F.col("psi").alias("drift_score"), (F.col("psi") >= threshold).alias("drift_detected"), F.lit(threshold).alias("threshold"), interpret_psi(F.col("psi")).alias("interpretation"))


def drift_summary(results: DataFrame) -> DataFrame:
    """Counts by severity of rows (metric, test_type, drift_score, p_value, drift_detected): PSI .1/.25, p-values .01/.001."""
    s, p, is_psi = F.col("drift_score"), F.col("p_value"), F.col("test_type") == "psi"
    severity = F.when(is_psi, F.when(s >= 0.25, "high").when(s >= 0.1, "medium").otherwise("low")).otherwise(F.when(p < 0.001, "high").when(p < 0.01, "medium").otherwise("low"))
    rows = results.withColumn("severity", severity)
    n = lambda v: F.count_if(F.col("severity") == v).alias(f"{v}_severity")
    return rows.agg(F.count(F.lit(1)).alias("total_tests"), F.count_if("drift_detected").alias("drift_count"), n("high"), n("medium"), n("low"))


def model_psi(reference: DataFrame, current: DataFrame, x: str) -> DataFrame:
    """One row (psi): bins = clamp(int(sqrt(n)), 3, 10), not stretched, so current values outside are left out; with fewer
    than three distinct edges equal widths over the reference's range; a constant reference and current give 0 or 1."""
    value = F.col(x).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    ref, cur = (df.filter(finite).select(F.lit("x").alias("metric"), value.alias("x")) for df in (reference, current))
    facts = ref.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    seen = cur.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spark = reference.sparkSession
    answer = lambda v: spark.createDataFrame([(float(v),)], "psi double")
    if not facts["n"] or not seen["n"]:
        return answer(0)
    if facts["lo"] == facts["hi"] and seen["lo"] == seen["hi"]:
        return answer(0 if facts["lo"] == seen["lo"] else 1)
    bins = min(10, max(3, int(min(facts["n"], seen["n"]) ** 0.5)))
    at = sorted(set(quantile_row(ref, {"x": F.col("x")}, [k / bins for k in range(bins + 1)]).first()["q_x"]))
    if len(at) < 3:
        lo, hi = (facts["lo"], facts["hi"]) if facts["lo"] < facts["hi"] else (facts["lo"] - 0.5, facts["hi"] + 0.5)
        at = [lo + (hi - lo) * k / bins for k in range(bins + 1)]
    edges = F.array(*[F.lit(float(e)) for e in at])
    sides = _binned(ref, edges, "n").select("bin", F.col("n").alias("b"), F.lit(0).alias("c")).union(_binned(cur, edges, "n").select("bin", F.lit(0), "n"))
    grid = spark.range(len(at) - 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    counts = sides.union(grid).groupBy("bin").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    totals = counts.agg(F.sum("b").alias("tb"), F.sum("c").alias("tc"))
    share = lambda n, t: F.when(F.col(n) == 0, F.lit(1e-6)).otherwise(F.col(n) / F.col(t))
    b, c = share("b", "tb"), share("c", "tc")
    return attach(counts, totals).filter("tb > 0 and tc > 0").agg(F.abs(F.coalesce(F.sum((c - b) * F.ln(c / b)), F.lit(0.0))).alias("psi"))


def categorical_psi(baseline: DataFrame, current: DataFrame, column: str, cap: float | None = None, epsilon: float = 1e-6) -> DataFrame:
    """One row (psi) over the categories of both sides; nulls are left out."""
    n = lambda df, name: df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    rows = n(baseline, "b").join(n(current, "c"), column, "full_outer").fillna(0, ["b", "c"])
    totals = rows.agg(F.sum("b").alias("tb"), F.sum("c").alias("tc"))
    b, c = (F.greatest(F.try_divide(F.col(k).cast("double"), F.col(f"t{k}").cast("double")), F.lit(epsilon)) for k in "bc")
    score = F.sum((c - b) * F.ln(c / b))
    return attach(rows, totals).agg((score if cap is None else F.least(score, F.lit(cap))).alias("psi"))


def category_counts(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    n = lambda df, name: df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return n(reference, "expected").join(n(current, "observed"), column, "full_outer").fillna(0, ["expected", "observed"])


def chi2_fit(reference: DataFrame, current: DataFrame, column: str) -> tuple[float, float]:
    """(statistic, p) of current against reference counts; (0, 1) where the totals differ or a category is new."""
    row = category_counts(reference, current, column).agg(F.sum("expected").alias("te"), F.sum("observed").alias("to"), F.min("expected").alias("low"), F.count(F.lit(1)).alias("k"), F.sum(F.try_divide(F.pow(F.col("observed") - F.col("expected"), F.lit(2)), F.col("expected").cast("double"))).alias("chi")).first()
    if not row["te"] or row["te"] != row["to"] or not row["low"]:
        return 0.0, 1.0
    return row["chi"], chi2_tail(row["chi"], row["k"] - 1) if row["k"] > 1 else 1.0


# ---------------------------------------------------------------- feature store baselines


def feature_baseline(df: DataFrame, x: str, percents: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """One row: count, mean, std, min, max and lower-rank percentiles, the element at int(p / 100 * (n - 1)) in order."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("n"))
    run = attach(sums_before(counts, "x", ["k"]), total)
    rank = lambda p: F.floor(F.lit(p / 100) * (F.col("n") - 1))
    at = [F.max(F.when((F.col("k_before") <= rank(p)) & (rank(p) < F.col("k_before") + F.col("k")), F.col("x"))).alias(f"p{p}") for p in percents]
    base = df.filter(F.col(x).isNotNull()).agg(F.count(x).alias("count"), F.avg(F.col(x).cast("double")).alias("mean"), F.stddev_samp(F.col(x).cast("double")).alias("std"), F.min(F.col(x).cast("double")).alias("min"), F.max(F.col(x).cast("double")).alias("max"))
    return attach(base, run.agg(*at))


def feature_shift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row (drift_score): mean of the shift of mean and of std in baseline stds, at most 1; 0 if the baseline's mean or std
    is 0. Not a real PSI."""
    b = baseline.select(F.col("mean").alias("bm"), F.col("std").alias("bs"))
    c = current.select(F.col("mean").alias("cm"), F.col("std").alias("cs"))
    m = F.abs(F.col("cm") - F.col("bm")) / F.nullif(F.col("bs"), F.lit(0.0))
    s = F.abs(F.col("cs") - F.col("bs")) / F.nullif(F.col("bs"), F.lit(0.0))
    none = (F.col("bm") == 0) | (F.coalesce("bs", F.lit(0.0)) == 0)
    return attach(b, c).select(F.when(none, F.lit(0.0)).otherwise(F.least((m + s) / 2, F.lit(1.0))).alias("drift_score"))


def drift_status(score: Column, low: float = 0.1, medium: float = 0.3, high: float = 0.5) -> Column:
    return F.when(score >= high, "high_drift").when(score >= medium, "medium_drift").when(score >= low, "low_drift").otherwise("no_drift")
