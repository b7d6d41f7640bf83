"""Fits over more statistics than the driver takes equal those over all of them."""

import numpy as np
import pytest

from tidemark.operators.models import _newton, fit_bgnbd, fit_gamma_gamma


def test_bgnbd_of_many_statistics(spark):
    rng = np.random.default_rng(7)
    rows = []
    for rate, drop, t in zip(rng.gamma(0.8, 1 / 12.0, 3000), rng.beta(0.9, 2.5, 3000), rng.uniform(50, 400, 3000)):
        x, now, last = 0, 0.0, 0.0
        while (now := now + rng.exponential(1 / rate)) < t:
            x, last = x + 1, now
            if rng.random() < drop:
                break
        rows.append((x, float(last), float(t)))
    df = spark.createDataFrame(rows, "frequency bigint, recency double, T double")
    whole, parts = fit_bgnbd(df), fit_bgnbd(df, most=500)
    for k in ("r", "alpha", "a", "b"):
        assert getattr(parts, k) == pytest.approx(getattr(whole, k), rel=1e-3), (whole, parts)


def test_gamma_gamma_of_many_statistics(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(2, 40, 3000)
    m = [float(rng.gamma(6.0 * k, 1 / v) / k) for k, v in zip(x, rng.gamma(4.0, 1 / 15.0, 3000))]
    df = spark.createDataFrame([(int(a), b) for a, b in zip(x, m)], "frequency bigint, monetary_value double")
    whole, parts = fit_gamma_gamma(df), fit_gamma_gamma(df, most=500)
    for k in ("p", "q", "gamma"):
        assert getattr(parts, k) == pytest.approx(getattr(whole, k), rel=1e-3), (whole, parts)


def test_newton_ends_at_a_bound():
    calls = []

    def losses(points):
        calls.append(1)
        x, y = points.T
        return 3 + (x - 1) ** 2 + 0.5 * (x - 1) * (y - 9) + (y - 9) ** 2

    got = _newton(losses, np.array([0.0, 0.0]), np.array([7.0, 7.0]))
    assert got == pytest.approx([1.5, 7.0], abs=1e-6) and len(calls) < 40


def test_chains_lie_around_the_fit(spark):
    from tidemark.operators.models import mcmc_diagnostics, sample_gamma_gamma

    rng = np.random.default_rng(8)
    x = rng.integers(2, 40, 2000)
    m = [float(rng.gamma(6.0 * k, 1 / v) / k) for k, v in zip(x, rng.gamma(4.0, 1 / 15.0, 2000))]
    df = spark.createDataFrame([(int(a), b) for a, b in zip(x, m)], "frequency bigint, monetary_value double")
    draws, fit = sample_gamma_gamma(df, draws=400, chains=3).toPandas(), fit_gamma_gamma(df)
    assert len(draws) == 3 * 400 * 3
    for k in ("p", "q", "gamma"):
        own = draws[draws.parameter == k].value
        assert abs(own.mean() - getattr(fit, k)) < 3 * own.std() and own.std() < getattr(fit, k)
    assert abs(draws[draws.parameter == "q"].value.mean() - 4) < 4 * draws[draws.parameter == "q"].value.std()
    assert all(r["ok"] for r in mcmc_diagnostics(spark.createDataFrame(draws)).collect())
