"""Densities, cumulative functions and inverses. Closed forms are columns; the gamma and normal families need series and run in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _from(x: Column, mu: float, value: Column, below: float = 0.0) -> Column:
    return F.when(x < mu, F.lit(below)).otherwise(value)


def exponential_pdf(x: Column, mu: float, rate: float) -> Column:
    return _from(x, mu, rate * F.exp(-rate * (x - mu)))


def exponential_cdf(x: Column, mu: float, rate: float) -> Column:
    return _from(x, mu, -F.expm1(-rate * (x - mu)))


def exponential_inverse(p: Column, mu: float, rate: float) -> Column:
    return mu - F.log1p(-p) / rate


def gumbel_pdf(x: Column, mu: float, lam: float) -> Column:
    y = lam * (x - mu)
    return lam * F.exp(-y - F.exp(-y))


def gumbel_cdf(x: Column, mu: float, lam: float) -> Column:
    return F.exp(-F.exp(-lam * (x - mu)))


def gumbel_survival(x: Column, mu: float, lam: float) -> Column:
    return -F.expm1(-F.exp(-lam * (x - mu)))


def gumbel_inverse(p: Column, mu: float, lam: float) -> Column:
    return mu - F.log(-F.log(p)) / lam


def gev_cdf(x: Column, mu: float, lam: float, alpha: float) -> Column:
    """Generalised extreme values; outside the support 0 or 1. A shape near zero is the Gumbel form."""
    if abs(alpha) < 1e-12:
        return gumbel_cdf(x, mu, lam)
    y = 1 + alpha * lam * (x - mu)
    return F.when(y <= 0, F.lit(0.0 if alpha > 0 else 1.0)).otherwise(F.exp(-F.pow(y, F.lit(-1 / alpha))))


def gev_inverse(p: Column, mu: float, lam: float, alpha: float) -> Column:
    if abs(alpha) < 1e-12:
        return gumbel_inverse(p, mu, lam)
    return mu + (F.pow(-F.log(p), F.lit(-alpha)) - 1) / (alpha * lam)


def weibull_pdf(x: Column, mu: float, lam: float, tau: float) -> Column:
    y = lam * (x - mu)
    return _from(x, mu, lam * tau * F.pow(y, F.lit(tau - 1)) * F.exp(-F.pow(y, F.lit(tau))))


def weibull_cdf(x: Column, mu: float, lam: float, tau: float) -> Column:
    return _from(x, mu, -F.expm1(-F.pow(lam * (x - mu), F.lit(tau))))


def weibull_inverse(p: Column, mu: float, lam: float, tau: float) -> Column:
    return mu + F.pow(-F.log1p(-p), F.lit(1 / tau)) / lam


def hyperexponential_cdf(x: Column, mu: float, parts: list[tuple[float, float]]) -> Column:
    """`parts`: (share, rate)."""
    return _from(x, mu, sum((q * -F.expm1(-rate * (x - mu)) for q, rate in parts), F.lit(0.0)))


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out, x = out - 1 / x, x + 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out, x = out + 1 / (x * x), x + 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def incomplete_gamma(a: float, x: np.ndarray) -> np.ndarray:
    """The regularised lower function P(a, x): the power series below a + 1, the continued fraction of Q above."""
    x = np.maximum(np.asarray(x, dtype=float), 0.0)
    front = np.zeros_like(x)
    plus = x > 0
    front[plus] = np.exp(a * np.log(x[plus]) - x[plus] - math.lgamma(a))
    out = np.zeros_like(x)
    low = plus & (x < a + 1)
    if low.any():
        v = x[low]
        term = np.full_like(v, 1 / a)
        total, k = term.copy(), a
        for _ in range(2000):
            k += 1
            term = term * v / k
            total += term
            if (term < total * 1e-16).all():
                break
        out[low] = front[low] * total
    high = plus & ~low
    if high.any():
        v, tiny = x[high], 1e-300
        b = v + 1 - a
        c, d = np.full_like(v, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(abs(t := an * d + b) < tiny, tiny, t)
            c = np.where(abs(t := b + an / c) < tiny, tiny, t)
            h = h * d * c
            if (abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - front[high] * h
    return np.clip(out, 0.0, 1.0)


def _batched(f, x: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        values = v.to_numpy(dtype=float, na_value=np.nan)
        held = ~np.isnan(values)
        out = np.full(len(values), np.nan)
        out[held] = f(values[held])
        return pd.Series(out).where(held, None)

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returnType="double")(x)


def gamma_cdf(x: Column, mu: float, lam: float, tau: float) -> Column:
    return _batched(lambda v: incomplete_gamma(tau, lam * (v - mu)), x)


def stretched_cdf(x: Column, mu: float, lam: float, tau: float) -> Column:
    """Stretched exponential with density in proportion to exp(-(lam (x - mu))^tau)."""
    return _batched(lambda v: incomplete_gamma(1 / tau, np.power(np.maximum(lam * (v - mu), 0), tau)), x)


def normal_cdf(x: Column, mean: float, sigma: float) -> Column:
    return _batched(lambda v: np.array([0.5 * math.erfc(-(a - mean) / (sigma * math.sqrt(2))) for a in v]), x)


def lognormal_cdf(x: Column, mu: float, sigma: float) -> Column:
    return F.when(x <= 0, F.lit(0.0)).otherwise(normal_cdf(F.log(F.when(x > 0, x)), mu, sigma))


def chi_squared_survival(x: float, degrees: int) -> float:
    return float(1 - incomplete_gamma(degrees / 2, np.array([x / 2]))[0])


def dirichlet_log_marginal(counts: Sequence[float], alpha: Sequence[float]) -> float:
    """Natural log of the probability of one order of the counted symbols under a Dirichlet prior."""
    a, n = sum(alpha), sum(counts)
    return math.lgamma(a) - math.lgamma(a + n) + sum(math.lgamma(x + c) - math.lgamma(x) for x, c in zip(alpha, counts))


def mixture_posterior(counts: Column, parts: Sequence[tuple[float, Sequence[float]]]) -> Column:
    """Mean posterior probabilities of an array of counts under a mixture of Dirichlet priors [(weight, alpha), ...]; null stays null."""

    def one(c: Sequence[float]) -> list[float]:
        logs = [math.log(q) + dirichlet_log_marginal(c, a) if q > 0 else -math.inf for q, a in parts]
        top = max(logs)
        share = [math.exp(x - top) for x in logs]
        total, n = sum(share), sum(c)
        return [sum(s * (x[k] + c[k]) / (n + sum(x)) for s, (_, x) in zip(share, parts)) / total for k in range(len(c))]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda c: None if c is None else one(list(c)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returnType="array<double>")(counts)
