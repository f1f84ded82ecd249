"""Families of distributions, each with the same forms: density, cumulative function and survival, plain and as logarithms, inverse and samples.

Closed forms are columns and stay exact in the tails; the gamma, stretched and normal families and the
inverses of mixtures need series or a search and run in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions import distributions as d

Form = Callable[[Column], Column]
NONE = float("-inf")


@dataclass(frozen=True)
class Family:
    """Outside its support a family has density 0 and logarithm minus infinity; null stays null."""

    log_pdf: Form
    cdf: Form
    survival: Form
    log_cdf: Form
    log_survival: Form
    inverse: Form

    def pdf(self, x: Column) -> Column:
        return F.exp(self.log_pdf(x))

    def sample(self, seed: int) -> Column:
        """A value per row; the seed and the row's place in its partition decide."""
        return self.inverse(F.lit(1.0) - F.rand(seed))


def _log(value: Column) -> Column:
    return F.when(value > 0, F.log(value)).when(value.isNotNull(), F.lit(NONE))


def _log1m_exp(v: Column) -> Column:
    """log(1 - exp(v)) for v <= 0 without loss near 0 and far below."""
    return F.when(v >= 0, F.lit(NONE)).when(v > -0.5, F.log(-F.expm1(v))).otherwise(F.log1p(-F.exp(v)))


def _above(x: Column, mu: float, value: Column, below: float) -> Column:
    return F.when(x < mu, F.lit(below)).otherwise(value)


def _searched(cdf: Callable[[np.ndarray], np.ndarray], low: float, p: Column) -> Column:
    """The inverse of an increasing function above `low`, by doubling and halving."""

    def run(v: np.ndarray) -> np.ndarray:
        a, width = np.full(len(v), low), np.ones(len(v))
        for _ in range(1100):
            short = cdf(a + width) < v
            if not short.any():
                break
            width = np.where(short, width * 2, width)
        b = a + width
        for _ in range(200):
            m = (a + b) / 2
            under = cdf(m) < v
            a, b = np.where(under, m, a), np.where(under, b, m)
        return np.where(v <= 0, low, np.where(v >= 1, np.inf, (a + b) / 2))

    return d._batched(run, p)


def exponential(mu: float, rate: float) -> Family:
    y = lambda x: rate * (x - mu)
    return Family(
        log_pdf=lambda x: _above(x, mu, math.log(rate) - y(x), NONE),
        cdf=lambda x: d.exponential_cdf(x, mu, rate),
        survival=lambda x: _above(x, mu, F.exp(-y(x)), 1.0),
        log_cdf=lambda x: _above(x, mu, _log1m_exp(-y(x)), NONE),
        log_survival=lambda x: _above(x, mu, -y(x), 0.0),
        inverse=lambda p: d.exponential_inverse(p, mu, rate),
    )


def gumbel(mu: float, lam: float) -> Family:
    y = lambda x: lam * (x - mu)
    return Family(
        log_pdf=lambda x: math.log(lam) - y(x) - F.exp(-y(x)),
        cdf=lambda x: d.gumbel_cdf(x, mu, lam),
        survival=lambda x: d.gumbel_survival(x, mu, lam),
        log_cdf=lambda x: -F.exp(-y(x)),
        log_survival=lambda x: _log1m_exp(-F.exp(-y(x))),
        inverse=lambda p: d.gumbel_inverse(p, mu, lam),
    )


def extreme_value(mu: float, lam: float, alpha: float) -> Family:
    """Generalised extreme values; a shape near zero is the Gumbel form."""
    if abs(alpha) < 1e-12:
        return gumbel(mu, lam)
    t = lambda x: 1 + alpha * lam * (x - mu)
    power = lambda x: F.pow(F.when(t(x) > 0, t(x)), F.lit(-1 / alpha))
    end, log_end = (0.0, NONE) if alpha > 0 else (1.0, 0.0)
    out = lambda x, value, beyond: F.when(t(x) <= 0, F.lit(beyond)).otherwise(value)
    return Family(
        log_pdf=lambda x: out(x, math.log(lam) - (1 + 1 / alpha) * F.log(F.when(t(x) > 0, t(x))) - power(x), NONE),
        cdf=lambda x: d.gev_cdf(x, mu, lam, alpha),
        survival=lambda x: out(x, -F.expm1(-power(x)), 1 - end),
        log_cdf=lambda x: out(x, -power(x), log_end),
        log_survival=lambda x: out(x, _log1m_exp(-power(x)), 0.0 if alpha > 0 else NONE),
        inverse=lambda p: d.gev_inverse(p, mu, lam, alpha),
    )


def weibull(mu: float, lam: float, tau: float) -> Family:
    y = lambda x: F.pow(F.when(x >= mu, lam * (x - mu)), F.lit(tau))
    return Family(
        log_pdf=lambda x: F.when(x <= mu, F.lit(NONE if tau >= 1 else math.inf) if tau != 1 else F.when(x < mu, F.lit(NONE)).otherwise(F.lit(math.log(lam)))).otherwise(math.log(lam * tau) + (tau - 1) * F.log(F.when(x > mu, lam * (x - mu))) - y(x)),
        cdf=lambda x: d.weibull_cdf(x, mu, lam, tau),
        survival=lambda x: _above(x, mu, F.exp(-y(x)), 1.0),
        log_cdf=lambda x: _above(x, mu, _log1m_exp(-y(x)), NONE),
        log_survival=lambda x: _above(x, mu, -y(x), 0.0),
        inverse=lambda p: d.weibull_inverse(p, mu, lam, tau),
    )


def _with_series(log_pdf: Form, cdf: Form, upper: Form, inverse: Form) -> Family:
    return Family(log_pdf=log_pdf, cdf=cdf, survival=upper, log_cdf=lambda x: _log(cdf(x)), log_survival=lambda x: _log(upper(x)), inverse=inverse)


def gamma(mu: float, lam: float, tau: float) -> Family:
    norm = tau * math.log(lam) - math.lgamma(tau)
    log_pdf = lambda x: F.when(x <= mu, F.lit(NONE)).otherwise(norm + (tau - 1) * F.log(F.when(x > mu, x - mu)) - lam * (x - mu))
    return _with_series(log_pdf, lambda x: d.gamma_cdf(x, mu, lam, tau), lambda x: 1 - d.gamma_cdf(x, mu, lam, tau), lambda p: _searched(lambda v: d.incomplete_gamma(tau, lam * (v - mu)), mu, p))


def stretched(mu: float, lam: float, tau: float) -> Family:
    norm = math.log(lam * tau) - math.lgamma(1 / tau)
    log_pdf = lambda x: _above(x, mu, norm - F.pow(F.when(x >= mu, lam * (x - mu)), F.lit(tau)), NONE)
    plain = lambda v: d.incomplete_gamma(1 / tau, np.power(np.maximum(lam * (v - mu), 0), tau))
    return _with_series(log_pdf, lambda x: d.stretched_cdf(x, mu, lam, tau), lambda x: 1 - d.stretched_cdf(x, mu, lam, tau), lambda p: _searched(plain, mu, p))


def normal(mean: float, sigma: float) -> Family:
    z = lambda v: (v - mean) / (sigma * math.sqrt(2))
    upper = lambda x: d._batched(lambda v: np.array([0.5 * math.erfc(z(a)) for a in v]), x)
    lower = lambda v: np.array([0.5 * math.erfc(-z(a)) for a in v])
    log_pdf = lambda x: F.lit(-math.log(sigma * math.sqrt(2 * math.pi))) - F.pow((x - mean) / sigma, F.lit(2)) / 2
    return _with_series(log_pdf, lambda x: d.normal_cdf(x, mean, sigma), upper, lambda p: _searched(lower, mean - 40 * sigma, p))


def lognormal(mu: float, sigma: float) -> Family:
    base = normal(mu, sigma)
    log = lambda x: F.log(F.when(x > 0, x))
    held = lambda x, value, below: F.when(x <= 0, F.lit(below)).otherwise(value)
    return _with_series(lambda x: held(x, base.log_pdf(log(x)) - log(x), NONE), lambda x: held(x, base.cdf(log(x)), 0.0), lambda x: held(x, base.survival(log(x)), 1.0), lambda p: F.exp(base.inverse(p)))


def _mixed(parts: Sequence[tuple[float, Family]], plain: Callable[[np.ndarray], np.ndarray], low: float) -> Family:
    total = lambda of: lambda x: sum((q * of(f)(x) for q, f in parts), F.lit(0.0))
    pdf, cdf, upper = total(lambda f: f.pdf), total(lambda f: f.cdf), total(lambda f: f.survival)
    return _with_series(lambda x: _log(pdf(x)), cdf, upper, lambda p: _searched(plain, low, p))


def hyperexponential(mu: float, parts: Sequence[tuple[float, float]]) -> Family:
    """`parts`: (share, rate)."""
    return _mixed([(q, exponential(mu, rate)) for q, rate in parts], lambda v: sum(q * -np.expm1(-rate * np.maximum(v - mu, 0)) for q, rate in parts), mu)


def extreme_value_mixture(parts: Sequence[tuple[float, float, float, float]]) -> Family:
    """`parts`: (share, mu, lambda, alpha)."""

    def one(v: np.ndarray, mu: float, lam: float, alpha: float) -> np.ndarray:
        if abs(alpha) < 1e-12:
            return np.exp(-np.exp(np.minimum(-lam * (v - mu), 700)))
        t = 1 + alpha * lam * (v - mu)
        with np.errstate(over="ignore"):
            return np.where(t <= 0, 0.0 if alpha > 0 else 1.0, np.exp(-np.power(np.maximum(t, 1e-300), -1 / alpha)))

    low = min(mu - 1000 / lam for _, mu, lam, _ in parts)
    return _mixed([(q, extreme_value(*rest)) for q, *rest in parts], lambda v: sum(q * one(v, *rest) for q, *rest in parts), low)


def chi_squared(degrees: int) -> Family:
    return gamma(0.0, 0.5, degrees / 2)


def g_test_p(g2: Column, degrees: int = 1) -> Column:
    """The probability of a G or chi-squared statistic at least this large by chance."""
    return chi_squared(degrees).survival(g2)
