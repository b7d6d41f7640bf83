"""Experiments: assignment by hash, targeting and flags, statistics of variants."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import md5_mod
from tidemark.functions.tails import chi2_tail, normal_cdf, normal_quantile, t_quantile, t_two_sided
from tidemark.operators.ordered import quantiles, sums_before

# ---------------------------------------------------------------- assignment


def bucket(experiment: str, user: Column) -> Column:
    """0 to 99.99: MD5 of "experiment:user" modulo 10,000, in hundredths."""
    return md5_mod(F.concat(F.lit(experiment + ":"), user), 10_000) / F.lit(100.0)


def assign(experiment: str, user: Column, allocation: dict[str, float]) -> Column:
    """The first variant whose cumulative per cent reaches the bucket (<=); null beyond the last."""
    b, out, total, steps = bucket(experiment, user), None, 0.0, []
    for name, share in allocation.items():
        total += share
        steps.append((total, name))
    for limit, name in steps:
        out = F.when(b <= limit, name) if out is None else out.when(b <= limit, name)
    return out


def assign_modulo(experiment: str, user: Column, allocation: dict[str, float], control: str) -> Column:
    """The first variant whose cumulative per cent exceeds MD5 modulo 100 (<); the control beyond the last."""
    b, out, total = md5_mod(F.concat(F.lit(experiment + ":"), user), 100), None, 0.0
    for name, share in allocation.items():
        total += share
        out = F.when(b < total, name) if out is None else out.when(b < total, name)
    return out.otherwise(control)


def gradual(allocation: dict[str, float], control: str, progress: float) -> dict[str, float]:
    """The allocation part-way through a rollout: treatments scaled by progress (0 to 1), the rest to the control."""
    scaled = {k: v * min(progress, 1.0) for k, v in allocation.items() if k != control}
    return {k: scaled.get(k, 100 - sum(scaled.values())) for k in allocation}


def assign_random(allocation: dict[str, float], control: str, seed: int) -> Column:
    """A random variant by cumulative per cent."""
    r, out, total = F.rand(seed) * 100, None, 0.0
    for name, share in allocation.items():
        total += share
        out = F.when(r < total, name) if out is None else out.when(r < total, name)
    return out.otherwise(control)


def eligible(columns: set[str], audience: dict, exclusions: dict, user: str = "user_id") -> Column:
    """Whether a user may take part: attributes that are present and not null must equal the audience's and differ from the
    exclusions'; a missing attribute passes."""
    ok = F.lit(True)
    for k, v in audience.items():
        c = user if k == "user_id" else k
        if c in columns:
            ok = ok & (F.col(c) == v if k == "user_id" else F.coalesce(F.col(c) == v, F.lit(True)))
    for k, v in exclusions.items():
        c = user if k == "user_id" else k
        if c in columns:
            ok = ok & ~F.coalesce(F.col(c) == v, F.lit(False))
    return ok


@dataclass(frozen=True)
class Rule:
    """Conditions on user_id, user_ids, attr_<name> (must be there) or <name> (counts if there); all must hold."""

    conditions: dict
    value: str
    priority: int = 0


def targeting(rules: list[Rule], columns: set[str], user: str = "user_id") -> Column:
    """The value of the first rule, by priority from high to low, that holds; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: r.priority):  # the last when put in front wins
        ok = F.lit(True)
        for k, v in rule.conditions.items():
            if k == "user_id":
                ok = ok & F.coalesce(F.col(user) == v, F.lit(False))
            elif k == "user_ids":
                ok = ok & F.coalesce(F.col(user).isin(list(v)), F.lit(False))
            elif k.startswith("attr_"):
                ok = ok & (F.coalesce(F.col(k[5:]) == v, F.lit(False)) if k[5:] in columns else F.lit(False))
            elif k in columns:
                ok = ok & F.coalesce(F.col(k) == v, F.lit(True))
        out = F.when(ok, rule.value).otherwise(out)
    return out


def flag(key: str, rules: list[Rule], columns: set[str], *, test: tuple[str, dict[str, float], dict[str, str]] | None = None, rollout: float = 0.0, on: str = "on", default: str = "off", user: str = "user_id") -> Column:
    """Targeting rules, then the test (name, allocation, value by variant), then the percentage rollout, then the default."""
    u = F.col(user).cast("string")
    steps = [targeting(rules, columns, user)]
    if test:
        name, allocation, values = test
        b, total, chosen = md5_mod(F.concat(F.lit(f"{key}:"), u, F.lit(f":{name}")), 10_000) / F.lit(100.0), 0.0, None
        for variant, share in allocation.items():
            total += share
            value = F.lit(values.get(variant))
            chosen = F.when(b <= total, value) if chosen is None else chosen.when(b <= total, value)
        steps.append(chosen)
    if rollout > 0:
        steps.append(F.when(u.isNotNull() & (bucket(key, u) <= rollout), on))
    return F.coalesce(*steps, F.lit(default))


# ---------------------------------------------------------------- statistics


def variant_stats(events: DataFrame, variant: str, value: Column, user: str | None = None) -> DataFrame:
    """(variant, n, mean, std, median) of a value; a null value counts as 1, an event of the metric without amount."""
    v = F.coalesce(value.cast("double"), F.lit(1.0))
    users = [F.count_distinct(user).alias("users")] if user else []
    out = events.groupBy(F.col(variant).alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), *users)
    middle = quantiles(events.select(F.col(variant).alias("variant_"), v.alias("v")), {"v": F.col("v")}, [0.5], ["variant_"]).select("variant_", F.col("q")[0].alias("median"))
    return out.join(middle, F.col("variant").eqNullSafe(F.col("variant_"))).select("variant", "n", "mean", "std", "median", *(["users"] if user else []))


@dataclass(frozen=True)
class Moments:
    n: int
    mean: float
    std: float


def moments(df: DataFrame, group: str, value: str) -> dict[str, Moments]:
    """n, mean and std (ddof 1) by group, from one aggregate; a handful of rows."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("m"), F.stddev_samp(F.col(value).cast("double")).alias("s"))
    return {r[0]: Moments(r["n"], r["m"], r["s"] or 0.0) for r in rows.collect()}


def t_test(a: Moments, b: Moments, *, welch: bool = True, alpha: float = 0.05) -> dict:
    """Difference b - a with Cohen's d; the confidence interval uses the unpooled error in both modes."""
    va, vb = a.std**2, b.std**2
    pooled = ((a.n - 1) * va + (b.n - 1) * vb) / (a.n + b.n - 2)
    plain = math.sqrt(va / a.n + vb / b.n)
    se = plain if welch else math.sqrt(pooled * (1 / a.n + 1 / b.n))
    df = (va / a.n + vb / b.n) ** 2 / ((va / a.n) ** 2 / (a.n - 1) + (vb / b.n) ** 2 / (b.n - 1)) if welch and plain else a.n + b.n - 2
    diff = b.mean - a.mean
    t = diff / se if se else 0.0
    half = t_quantile(1 - alpha / 2, df) * plain
    d = diff / math.sqrt(pooled) if pooled else 0.0
    return {"statistic": t, "p_value": t_two_sided(t, df), "df": df, "effect_size": d, "hedges_g": hedges(d, a.n + b.n), "low": diff - half, "high": diff + half}


def hedges(d: float, n: int) -> float:
    return d * (1 - 3 / (4 * n - 9))


def proportions(x1: int, n1: int, x2: int, n2: int, alpha: float = 0.05) -> dict:
    """Two-proportion z-test with the pooled error in the interval too."""
    p1, p2, p = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = (p2 - p1) / se if se else 0.0
    half = normal_quantile(1 - alpha / 2) * se
    return {"statistic": z, "p_value": 2 * (1 - normal_cdf(abs(z))), "effect_size": p2 - p1, "low": p2 - p1 - half, "high": p2 - p1 + half}


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str) -> dict:
    """U of the first group with average ranks for ties, normal approximation with tie and continuity correction, and the
    rank-biserial effect 1 - 2U / (n1 n2). Ranks come from value counts."""
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull() & F.col(group).isin(first, second)).groupBy(v.alias("x")).agg(F.count_if(F.col(group) == first).alias("a"), F.count(F.lit(1)).alias("k"))
    rank = F.col("k_before") + (F.col("k") + 1) / 2
    row = sums_before(counts, "x", ["k"]).agg(F.sum("a").alias("n1"), F.sum("k").alias("n"), F.sum(F.col("a") * rank).alias("r1"), F.sum(F.pow(F.col("k").cast("double"), F.lit(3)) - F.col("k")).alias("ties")).first()
    n1, n = row["n1"], row["n"]
    n2 = n - n1
    u = row["r1"] - n1 * (n1 + 1) / 2
    mean, var = n1 * n2 / 2, n1 * n2 / 12 * (n + 1 - row["ties"] / (n * (n - 1)))
    z = (abs(u - mean) - 0.5) / math.sqrt(var) if var else 0.0
    return {"statistic": u, "p_value": min(1.0, 2 * (1 - normal_cdf(max(z, 0.0)))), "effect_size": 1 - 2 * u / (n1 * n2)}


def chi2_contingency(df: DataFrame, row: str, column: str) -> dict:
    """Chi-square of a contingency table (Yates for 2 x 2) and Cramer's V. Cells are rows x columns of categories."""
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rows, columns = cells.groupBy("r").agg(F.sum("n").alias("nr")), cells.groupBy("c").agg(F.sum("n").alias("nc"))
    k, m = rows.count(), columns.count()
    total = cells.agg(F.sum("n")).first()[0]
    if k == m == 2:  # with Yates' correction, from the four cells
        n = {(x["r"], x["c"]): x["n"] for x in cells.collect()}
        down, across = rows.collect(), columns.collect()
        chi = sum(max(abs(n.get((r["r"], c["c"]), 0) - e) - 0.5, 0.0) ** 2 / e for r in down for c in across for e in [r["nr"] * c["nc"] / total])
    else:  # empty cells need no row: the sum over all of (n - e)^2 / e is total * (sum of n^2 / (nr nc) - 1)
        share = F.sum(F.pow(F.col("n").cast("double"), F.lit(2)) / (F.col("nr").cast("double") * F.col("nc")))
        chi = total * (cells.join(rows, "r").join(columns, "c").agg(share).first()[0] - 1)
    df_ = (k - 1) * (m - 1)
    return {"statistic": chi, "p_value": chi2_tail(chi, df_) if df_ else 1.0, "df": df_, "effect_size": math.sqrt(chi / (total * max(1, min(k, m) - 1)))}


def sequential(a: Moments, b: Moments, alpha: float = 0.05, beta: float = 0.2, effect: float = 0.5) -> dict:
    """Sequential boundaries on the standardised difference of two groups. Sizes may differ: the error is that of both, and the
    information that of the harmonic mean of the sizes, which is the size where they are equal."""
    se = math.sqrt(a.std**2 / a.n + b.std**2 / b.n)
    z = (b.mean - a.mean) / se if se else 0.0
    theta = effect / math.sqrt(2)
    information = 2 / (1 / a.n + 1 / b.n) * theta**2 / 2
    upper, lower, now = math.log((1 - beta) / alpha) / theta, math.log(beta / (1 - alpha)) / theta, z * math.sqrt(information)
    return {"decision": "reject_h0" if now >= upper else "accept_h0" if now <= lower else "continue", "statistic": now, "upper": upper, "lower": lower, "information": information}


def bayes_normal(a: Moments, b: Moments, rope: float = 0.0) -> dict:
    """P(B > A), expected losses and the share inside +-rope under flat priors: the difference of means is normal."""
    sd = math.sqrt(a.std**2 / a.n + b.std**2 / b.n) or 1e-12
    diff = b.mean - a.mean
    z = diff / sd
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    better = normal_cdf(z)
    return {"prob_b_better": better, "loss_a": diff * better + sd * density, "loss_b": -diff * (1 - better) + sd * density, "prob_in_rope": normal_cdf((rope - diff) / sd) - normal_cdf((-rope - diff) / sd)}


def sample_size(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Per group, for a two-sided t-test of two equal groups: the normal answer raised until Student's t agrees."""
    n = max(2, math.ceil(2 * ((normal_quantile(1 - alpha / 2) + normal_quantile(power)) / effect) ** 2))
    while power_of(n, effect, alpha) < power:
        n += 1
    return n


def power_of(n: int, effect: float, alpha: float = 0.05) -> float:
    """Approximate power: the noncentral t around its mean, with the variance of the normal."""
    df = 2 * n - 2
    shift, critical = abs(effect) * math.sqrt(n / 2), t_quantile(1 - alpha / 2, df)
    return normal_cdf((shift * (1 - 1 / (4 * df)) - critical) / math.sqrt(1 + critical**2 / (2 * df)))


def smallest_effect(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    low, high = 0.0, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if power_of(n, mid, alpha) < power else (low, mid)
    return (low + high) / 2


def adjust(p_values: DataFrame, method: str) -> DataFrame:
    """(name, p_value, adjusted) by bonferroni, sidak, holm, fdr_bh or fdr_by; a handful of tests by nature."""
    w = Window.orderBy("p_value", "name")
    rows = p_values.select("name", "p_value", F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    p, k, m = F.col("p_value"), F.col("k"), F.col("m")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    harmonic = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda s, i: s + 1 / i)
    raw = {"bonferroni": p * m, "sidak": 1 - F.pow(1 - p, m), "holm": F.max(p * (m - k + 1)).over(up), "fdr_bh": F.min(p * m / k).over(down), "fdr_by": F.min(p * m / k * harmonic).over(down)}[method]
    return rows.select("name", "p_value", F.least(raw, F.lit(1.0)).alias("adjusted"))


def stopping(stats: DataFrame, *, min_n: int, max_days: float, days: float, p_value: float | None, alpha: float = 0.05) -> DataFrame:
    """One row (stop, reason): not below min_n per variant, then by time, then by significance."""
    low = F.min("n")
    significant = F.lit(p_value is not None and p_value < alpha)
    reason = F.when(low < min_n, "too few samples").when(F.lit(days >= max_days), "time is up").when(significant, "significant").otherwise("go on")
    return stats.agg(reason.alias("reason")).select(F.col("reason").isin("time is up", "significant").alias("stop"), "reason")
