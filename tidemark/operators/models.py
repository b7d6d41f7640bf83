"""Inputs, fits and scores of the BG/NBD and Gamma-Gamma models, and lifetime value.

Fitting groups customers with equal statistics and counts them in Spark, then maximises the published likelihoods over
those counts: on the driver where they are few, else by an aggregate over all of them at each step. Closed forms are Columns; the hypergeometric function runs in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import elapsed_us
from tidemark.functions.rows import attach
from tidemark.operators.ordered import quantile_row, quantiles
from tidemark.session import checkpointed

DAY_US = 86_400_000_000


def days_between(later: Column, earlier: Column) -> Column:
    return elapsed_us(later, earlier) / F.lit(float(DAY_US))


def bgnbd_inputs(periods: DataFrame, observation_end: Column) -> DataFrame:
    """(customer_id, frequency, recency, T) of one granularity: repeat orders, days from the first start to the last end if any
    repeat, days from the first start to the observation's end. Periods that end after the observation are left out."""
    rows = periods.filter(F.col("customer_id").isNotNull() & (F.col("period_end") <= observation_end))
    g = rows.groupBy("customer_id").agg(F.sum("total_orders").alias("orders"), F.min("period_start").alias("first"), F.max("period_end").alias("last"))
    frequency = F.greatest(F.col("orders") - 1, F.lit(0))
    return g.select("customer_id", frequency.alias("frequency"), F.when(frequency > 0, days_between(F.col("last"), F.col("first"))).otherwise(0.0).alias("recency"), days_between(observation_end, F.col("first")).alias("T"))


def gamma_gamma_inputs(periods: DataFrame, min_frequency: int = 2) -> DataFrame:
    """(customer_id, frequency, monetary_value) of customers with at least that many orders and a positive mean."""
    g = periods.filter("customer_id is not null").groupBy("customer_id").agg(F.sum("total_orders").alias("frequency"), F.sum("total_spend").alias("spend"))
    mean = F.round(F.col("spend").cast("decimal(28,10)") / F.nullif(F.col("frequency"), F.lit(0)), 2).cast("decimal(18,2)")
    return g.filter(F.col("frequency") >= min_frequency).select("customer_id", "frequency", mean.alias("monetary_value"))


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Nelder-Mead with the usual coefficients."""
    n = len(start)
    points = np.vstack([start, *(start + 0.3 * np.eye(n))])
    values = np.array([f(p) for p in points])
    for _ in range(steps):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = points[:-1].mean(0)
        trial = centre + (centre - points[-1])
        value = f(trial)
        if value < values[0]:
            far = centre + 2 * (centre - points[-1])
            trial, value = (far, v) if (v := f(far)) < value else (trial, value)
        elif value >= values[-2]:
            outside = value < values[-1]
            near = centre + 0.5 * ((trial if outside else points[-1]) - centre)
            v = f(near)
            if v < min(value, values[-1]):
                trial, value = near, v
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = trial, value
    return points[np.argmin(values)]


_lgamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass(frozen=True)
class BgNbd:
    r: float
    alpha: float
    a: float
    b: float


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    gamma: float


def _sufficient(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct statistics, as they are, with their counts n."""
    return checkpointed(df.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).cast("double").alias("n")))


def _losses(stats: DataFrame, terms: Callable[..., np.ndarray], points: np.ndarray) -> np.ndarray:
    """The mean negative log-likelihood at each point, by one aggregate over all statistics."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(points) + 1)
        for batch in batches:
            *columns, n = batch.to_numpy(dtype=float).T
            total += [*((n * terms(p, *columns)).sum() for p in points), n.sum()]
        yield pd.DataFrame({"k": np.arange(len(total)), "s": total})

    sums = dict(stats.mapInPandas(part, "k int, s double").groupBy("k").agg(F.sum("s")).collect())
    return -np.array([sums[k] for k in range(len(points))]) / sums[len(points)]


def _newton(losses: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, bounds: np.ndarray, steps: int = 50, h: float = 3e-4) -> np.ndarray:
    """Damped Newton steps within +-bounds. Each takes two calls of ``losses``: one for gradient and curvature by
    differences, one for the steps tried."""
    n = len(theta)
    unit, pairs = h * np.eye(n), [(i, j) for i in range(n) for j in range(i)]
    offsets = np.vstack([np.zeros(n), unit, -unit, *(unit[i] + unit[j] for i, j in pairs), *(-unit[i] - unit[j] for i, j in pairs)])
    for _ in range(steps):
        f = losses(theta + offsets)
        up, down, both, neither = f[1 : n + 1], f[n + 1 : 2 * n + 1], f[2 * n + 1 : 2 * n + 1 + len(pairs)], f[2 * n + 1 + len(pairs) :]
        slope, curve = (up - down) / (2 * h), np.diag((up + down - 2 * f[0]) / h**2)
        for (i, j), p, m in zip(pairs, both, neither):
            curve[i, j] = curve[j, i] = (p + m + 2 * f[0] - up[i] - up[j] - down[i] - down[j]) / (2 * h**2)
        free = ~((np.abs(theta) >= bounds - 1e-9) & (slope * theta < 0))  # the others are held at their bounds
        if not free.any():
            break
        values, vectors = np.linalg.eigh(curve[np.ix_(free, free)])
        tried = []
        for damping in (0, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1, 10):
            d = np.zeros(n)
            d[free] = -vectors @ ((vectors.T @ slope[free]) / (np.maximum(np.abs(values), 1e-8) + damping))
            tried.append(np.clip(theta + d * min(1.0, 2.0 / max(np.abs(d).max(), 1e-300)), -bounds, bounds))
        g = losses(np.array(tried))
        k = int(np.argmin(g))
        if g[k] < f[0]:
            theta = tried[k]
        if f[0] - g[k] <= 1e-12 * (abs(f[0]) + 1e-12):
            break
    return theta


def _fit(stats: DataFrame, terms: Callable[..., np.ndarray], start: Callable[..., list[float]], bounds: np.ndarray, most: int) -> np.ndarray:
    """The parameters of greatest likelihood: on the driver if there are at most ``most`` statistics; otherwise a fit of a
    part of them only gives the start, and all of them are aggregated in Spark at each step."""
    large = stats.count() > most
    picked = stats.orderBy(F.xxhash64(*stats.columns), *stats.columns).limit(min(most, 20_000)) if large else stats
    *columns, n = picked.toPandas().to_numpy(dtype=float).T

    def loss(theta: np.ndarray) -> float:
        if np.any(np.abs(theta) > bounds):  # beyond lies no other fit, only a flat ridge
            return 1e18
        return -float((n * terms(theta, *columns)).sum() / n.sum())

    theta = minimise(loss, np.array(start(*columns)))
    return np.exp(_newton(lambda points: _losses(stats, terms, points), theta, bounds) if large else theta)


def _of_counts(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """f(x), worked out once for each distinct count."""
    distinct, at = np.unique(x, return_inverse=True)
    return f(distinct)[at]


def _bgnbd_terms(theta: np.ndarray, x: np.ndarray, tx: np.ndarray, t: np.ndarray) -> np.ndarray:
    r, alpha, a, b = np.exp(theta)
    tx = np.minimum(tx, t)
    a1 = _of_counts(lambda x: _lgamma(r + x), x) - math.lgamma(r) + r * math.log(alpha)
    a2 = math.lgamma(a + b) + _of_counts(lambda x: _lgamma(b + x) - _lgamma(a + b + x), x) - math.lgamma(b)
    a3 = -(r + x) * np.log(alpha + t)
    with np.errstate(divide="ignore", invalid="ignore"):
        a4 = np.where(x > 0, math.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + tx), -np.inf)
    return a1 + a2 + np.logaddexp(a3, a4)


def _gamma_gamma_terms(theta: np.ndarray, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    p, q, g = np.exp(theta)
    return _of_counts(lambda x: _lgamma(p * x + q) - _lgamma(p * x) + p * x * np.log(x), x) - math.lgamma(q) + q * math.log(g) + (p * x - 1) * np.log(m) - (p * x + q) * np.log(g + m * x)


def fit_bgnbd(inputs: DataFrame, most: int = 200_000) -> BgNbd:
    """Maximum likelihood over (frequency, recency, T); customers with the same three are counted together, none is rounded."""
    stats = _sufficient(inputs, ["frequency", "recency", "T"])
    return BgNbd(*_fit(stats, _bgnbd_terms, lambda x, tx, t: [0.0, math.log(max(t.mean() / 4, 1)), 0.0, 1.0], np.array([8.0, 14.0, 7.0, 7.0]), most))


def fit_gamma_gamma(inputs: DataFrame, most: int = 200_000) -> GammaGamma:
    """Maximum likelihood over (frequency, monetary_value) of customers with a positive value, none rounded."""
    stats = _sufficient(inputs.filter("monetary_value > 0"), ["frequency", "monetary_value"])
    return GammaGamma(*_fit(stats, _gamma_gamma_terms, lambda x, m: [1.0, 1.0, math.log(m.mean())], np.array([14.0] * 3), most))


#: Standard deviation of the normal prior of each parameter's logarithm.
PRIOR = 3.0


def _posterior_draws(stats: DataFrame, terms: Callable[..., np.ndarray], theta: np.ndarray, names: tuple[str, ...], draws: int, chains: int, seed: int, at_once: int = 250) -> DataFrame:
    """(parameter, chain, draw, value): a Markov chain of independent proposals around the fit, with the fit's own curvature.

    Proposals don't depend on the chains' states, so all are weighed first, many in one aggregate over the statistics, however
    large their table; the chains then accept or refuse them on the driver.
    """
    k, n = len(theta), stats.agg(F.sum("n")).first()[0]
    unit, h = np.eye(k), 1e-3
    offsets = np.array([np.zeros(k), *(s * h * unit[i] + t * h * unit[j] for i in range(k) for j in range(k) for s in (1, -1) for t in (1, -1))])
    f = _losses(stats, terms, theta + offsets) * n
    four = f[1:].reshape(k, k, 2, 2)
    curve = (four[:, :, 0, 0] - four[:, :, 0, 1] - four[:, :, 1, 0] + four[:, :, 1, 1]) / (4 * h * h) + np.eye(k) / PRIOR**2
    values, vectors = np.linalg.eigh((curve + curve.T) / 2)
    values = np.maximum(values, 1 / PRIOR**2)
    rng, tail = np.random.default_rng(seed), 5
    z = rng.standard_normal((chains, draws + 1, k)) / np.sqrt(rng.chisquare(tail, (chains, draws + 1, 1)) / tail)
    points = theta + z @ (vectors * np.sqrt(1.2 / values)).T
    flat = points.reshape(-1, k)
    loss = np.concatenate([_losses(stats, terms, flat[i : i + at_once]) for i in range(0, len(flat), at_once)]) * n
    weight = (-loss - (flat**2).sum(1) / (2 * PRIOR**2)).reshape(chains, draws + 1) + (tail + k) / 2 * np.log1p((z**2).sum(2) / tail)
    weight = np.where(np.isfinite(weight), weight, -np.inf)
    rows, chance = [], np.log(rng.random((chains, draws + 1)))
    for c in range(chains):
        at = 0
        for i in range(1, draws + 1):
            at = i if weight[c, i] - weight[c, at] >= chance[c, i] else at
            rows += [(name, c, i, float(v)) for name, v in zip(names, np.exp(points[c, at]))]
    return stats.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["parameter", "chain", "draw", "value"]), "parameter string, chain int, draw int, value double")


def sample_bgnbd(inputs: DataFrame, draws: int = 1000, chains: int = 4, seed: int = 1) -> DataFrame:
    """Posterior draws of r, alpha, a and b, under normal priors of their logarithms."""
    model = fit_bgnbd(inputs)
    return _posterior_draws(_sufficient(inputs, ["frequency", "recency", "T"]), _bgnbd_terms, np.log([model.r, model.alpha, model.a, model.b]), ("r", "alpha", "a", "b"), draws, chains, seed)


def sample_gamma_gamma(inputs: DataFrame, draws: int = 1000, chains: int = 4, seed: int = 1) -> DataFrame:
    """Posterior draws of p, q and gamma, under normal priors of their logarithms."""
    model = fit_gamma_gamma(inputs)
    return _posterior_draws(_sufficient(inputs.filter("monetary_value > 0"), ["frequency", "monetary_value"]), _gamma_gamma_terms, np.log([model.p, model.q, model.gamma]), ("p", "q", "gamma"), draws, chains, seed)


def prob_alive(model: BgNbd) -> Column:
    x, tx, t = F.col("frequency").cast("double"), F.col("recency"), F.col("T")
    odds = F.lit(model.a) / (F.lit(model.b) + x - 1) * F.pow((F.lit(model.alpha) + t) / (F.lit(model.alpha) + tx), F.lit(model.r) + x)
    return F.when(x > 0, 1 / (1 + odds)).otherwise(F.lit(1.0))


def hyp2f1(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray, log_factor: np.ndarray | float = 0.0) -> np.ndarray:
    """The hypergeometric series for 0 <= z < 1 times exp(log_factor), summed until terms vanish; sums are scaled down before
    they overflow, and the factor brings them back."""
    a, b, c, z, factor = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, c, z, log_factor)))
    term, total, scale = np.ones(a.shape), np.ones(a.shape), factor.copy()
    for k in range(20_000):
        term = term * ((a + k) / (c + k) * ((b + k) / (k + 1)) * z)
        total = total + term
        if (large := np.abs(term) > 1e150).any():
            term, total, scale = np.where(large, term * 1e-150, term), np.where(large, total * 1e-150, total), np.where(large, scale + 150 * math.log(10), scale)
        if np.all(np.abs(term) <= 1e-13 * np.abs(total)):
            break
    return total * np.exp(scale)


def expected_purchases(model: BgNbd, horizon: float) -> Callable:
    """A Pandas UDF of (frequency, recency, T): purchases expected over the horizon in days."""
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    a = a + 1e-9 if abs(a - 1) < 1e-9 else a

    @F.pandas_udf("double")
    def expect(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, tx, t in batches:
            x, tx, t = (np.asarray(v, float) for v in (x, tx, t))
            z = horizon / (alpha + t + horizon)
            # Euler's transformation leaves small parameters, so that many purchases don't overflow the series
            grown = (a + b + x - 1) / (a - 1) * (1 - hyp2f1(a + b - 1 - r, a - 1, a + b + x - 1, z, (a - 1) * np.log1p(-z)))
            with np.errstate(over="ignore"):
                alive = 1 + (x > 0) * a / np.where(x > 0, b + x - 1, 1) * ((alpha + t) / (alpha + tx)) ** (r + x)
            yield pd.Series(grown / alive)

    return expect


def expected_spend(model: GammaGamma) -> Column:
    """The conditional mean spend of a customer with frequency and monetary_value."""
    x, m = F.col("frequency").cast("double"), F.col("monetary_value").cast("double")
    return F.lit(model.p) * (F.lit(model.gamma) + x * m) / (F.lit(model.p) * x + F.lit(model.q) - 1)


def clv(purchases: DataFrame, alive: DataFrame, spend: DataFrame, months: int = 12, margin: float = 0.30, rate: float = 0.10) -> DataFrame:
    """Purchases x spend x margin, discounted by 1 / (1 + rate)^(months / 12), best first; a customer without spend gets 0.
    Rounded half to even: 2, 2, 2 and 3 places. P(alive) is shown but not multiplied in."""
    rows = purchases.join(alive, "customer_id", "left").join(spend, "customer_id", "left")
    value = F.coalesce("predicted_avg_value", F.lit(0.0))
    even = lambda c, n: F.bround(c.cast("decimal(38,10)"), n).cast("double")
    total = F.col("predicted_purchases") * value * margin / (1 + rate) ** (months / 12)
    out = rows.select("customer_id", even(F.col("predicted_purchases"), 2).alias("predicted_purchases"), even(value, 2).alias("predicted_avg_value"), even(total, 2).alias("clv"), even(F.col("prob_alive"), 3).alias("prob_alive"))
    return out.orderBy(F.desc("clv"), "customer_id")


def horizon_days(months: int) -> float:
    return months * 365.25 / 12


def effective_size(chains: list[np.ndarray]) -> float:
    """The effective sample size of chains of draws by the autocorrelation at all lags: chains are split in halves, sums of
    two neighbouring lags count as long as they are positive and never grow, and the size is at most n log10 n."""
    n = min(len(c) for c in chains) // 2
    if n < 4:
        return float("nan")
    halves = np.array([h for c in chains for h in (c[:n], c[len(c) - n :])], float)
    centred = halves - halves.mean(1, keepdims=True)
    spectrum = np.fft.rfft(centred, 1 << (2 * n - 1).bit_length())
    cov = np.fft.irfft(np.abs(spectrum) ** 2)[:, :n].mean(0) / n
    within = cov[0] * n / (n - 1)
    total = within * (n - 1) / n + halves.mean(1).var(ddof=1)
    if total <= 0:
        return float(halves.size)
    rho = 1 - (within - cov * n / (n - 1)) / total
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    stop = int(np.argmax(pairs <= 0)) if (pairs <= 0).any() else len(pairs)
    tau = -1 + 2 * np.minimum.accumulate(pairs[:stop]).sum()
    return float(min(halves.size / max(tau, 1e-300), halves.size * math.log10(halves.size)))


def mcmc_diagnostics(draws: DataFrame) -> DataFrame:
    """(parameter, r_hat, ess, ok) from draws (parameter, chain, draw, value): the potential scale reduction (at most 1.1) and the
    effective sample size by ``effective_size`` (at least 400). A parameter's draws, which a sampler keeps few, meet in one task
    for their autocorrelation; null values are left out."""
    chains = draws.groupBy("parameter", "chain").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    per = chains.groupBy("parameter").agg(F.avg("n").alias("n"), F.var_samp("m").alias("b"), F.avg("v").alias("w"))
    n = F.col("n")
    r_hat = F.sqrt(((n - 1) / n * F.col("w") + F.coalesce("b", F.lit(0.0))) / F.nullif(F.col("w"), F.lit(0.0)))

    def size(rows: pd.DataFrame) -> pd.DataFrame:
        own = [g.sort_values("draw")["value"].to_numpy(float) for _, g in rows.groupby("chain")]
        return pd.DataFrame({"parameter": rows["parameter"].iloc[:1], "ess": [effective_size(own)]})

    ess = draws.filter("value is not null").select("parameter", "chain", "draw", F.col("value").cast("double").alias("value")).groupBy("parameter").applyInPandas(size, "parameter string, ess double")
    return per.join(ess, "parameter").select("parameter", r_hat.alias("r_hat"), "ess", ((r_hat <= 1.1) & (F.col("ess") >= 400)).alias("ok"))


def posterior_checks(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: share of observations inside their central 95 % of predictive draws, and both medians."""
    q = quantiles(draws, {"value": F.col("value")}, [0.025, 0.5, 0.975], ["obs_id"]).select("obs_id", "q")
    j = observed.join(q, "obs_id").select("observed", "q")
    medians = quantile_row(j, {"o": F.col("observed"), "p": F.col("q")[1]}, [0.5]).select(F.col("q_o")[0].alias("observed_median"), F.col("q_p")[0].alias("predicted_median"))
    return attach(j.agg(F.avg(F.col("observed").between(F.col("q")[0], F.col("q")[2]).cast("double")).alias("coverage_95")), medians)
