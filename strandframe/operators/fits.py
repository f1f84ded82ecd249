"""Maximum-likelihood fits that need iteration. Each step is one aggregation of a few sums, or works on a summary of fixed size; no sample reaches the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.distributions import chi_squared_survival, digamma, trigamma


def _samples(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))


def fit_gamma(df: DataFrame, value: str, mu: float = 0.0) -> tuple[float, float]:
    """(lambda, tau) for known mu: the sums of x and ln x suffice, so it is one pass."""
    mean, log_mean = _samples(df, value).where(F.col("x") > mu).agg(F.avg(F.col("x") - mu), F.avg(F.log(F.col("x") - mu))).first()
    if mean is None:
        raise ValueError("no sample above mu")
    c = math.log(mean) - log_mean
    if c <= 0:
        raise ValueError("all samples are equal")
    tau = (3 - c + math.sqrt((c - 3) ** 2 + 24 * c)) / (12 * c)
    for _ in range(100):
        step = (math.log(tau) - digamma(tau) - c) / (1 / tau - trigamma(tau))
        tau = tau - step if step < tau else tau / 2
        if abs(step) < 1e-12 * tau:
            break
    return tau / mean, tau


def fit_weibull(df: DataFrame, value: str, mu: float = 0.0, *, most_steps: int = 60) -> tuple[float, float]:
    """(lambda, tau) for known mu, by Newton's method on the shape."""
    x = _samples(df, value).where(F.col("x") > mu).select((F.col("x") - mu).alias("x"))
    n, top, log_mean, log_sd = x.agg(F.count("*"), F.max("x"), F.avg(F.log("x")), F.stddev_samp(F.log("x"))).first()
    if not n or not log_sd:
        raise ValueError("two different samples above mu are needed")
    log_top, tau = math.log(top), 1.28255 / log_sd
    y = F.log("x") - log_top  # so no power overflows
    for _ in range(most_steps):
        e = F.exp(F.lit(tau) * y)
        s0, s1, s2 = x.agg(F.sum(e), F.sum(e * y), F.sum(e * y * y)).first()
        f = s1 / s0 - 1 / tau - (log_mean - log_top)
        step = f / (s2 / s0 - (s1 / s0) ** 2 + 1 / tau**2)
        tau = tau - step if step < tau else tau / 2
        if abs(step) < 1e-9 * tau:
            break
    s0 = x.agg(F.sum(F.exp(F.lit(tau) * y))).first()[0]
    return (s0 / n) ** (-1 / tau) / top, tau


def fit_gumbel_censored(df: DataFrame, value: str, phi: float, n_censored: int, *, most_steps: int = 60) -> tuple[float, float]:
    """(mu, lambda) from the samples >= phi when `n_censored` more lie below it."""
    x = _samples(df, value).where(F.col("x") >= phi).select((F.col("x") - phi).alias("x"))
    n, mean, sd = x.agg(F.count("*"), F.avg("x"), F.stddev_samp("x")).first()
    if not n or not sd:
        raise ValueError("two different samples above phi are needed")
    lam, z = math.pi / math.sqrt(6) / sd, n_censored  # the unseen samples count at phi, which is 0 here
    for _ in range(most_steps):
        e = F.exp(-F.lit(lam) * F.col("x"))
        s0, s1, s2 = x.agg(F.sum(e), F.sum(e * F.col("x")), F.sum(e * F.col("x") ** 2)).first()
        s0 += z
        step = (1 / lam - mean + s1 / s0) / (-1 / lam**2 - s2 / s0 + (s1 / s0) ** 2)
        lam = lam - step if step < lam else lam / 2
        if abs(step) < 1e-9 * lam:
            break
    s0 = x.agg(F.sum(F.exp(-F.lit(lam) * F.col("x")))).first()[0] + z
    return phi - math.log(s0 / n) / lam, lam


def goodness_of_fit(bins: DataFrame, cdf, *, fitted: int = 0) -> tuple[int, float, float, float, float]:
    """(n_bins, G, P of G, X2, P of X2) of `bins(lo, hi, obs)` against `cdf(x: float)`. Neighbouring bins are joined until each holds enough samples; bins do not grow with the samples."""
    rows = [tuple(r) for r in bins.select("lo", "hi", "obs").orderBy("lo").collect()]
    n = sum(r[2] for r in rows)
    if not n:
        raise ValueError("no samples")
    least = 1 + n / (2 * (2 * int(n**0.4)))
    merged: list[list[float]] = []
    for lo, hi, obs in rows:
        if merged and merged[-1][2] < least:
            merged[-1][1], merged[-1][2] = hi, merged[-1][2] + obs
        else:
            merged.append([lo, hi, obs])
    if len(merged) > 1 and merged[-1][2] < least:
        _, hi, obs = merged.pop()
        merged[-1][1], merged[-1][2] = hi, merged[-1][2] + obs
    span = cdf(merged[-1][1]) - cdf(merged[0][0])
    g = x2 = 0.0
    for lo, hi, obs in merged:
        want = max(n * (cdf(hi) - cdf(lo)) / span, 1e-300)
        g += 2 * obs * math.log(obs / want)
        x2 += (obs - want) ** 2 / want
    free = max(1, len(merged) - 1 - fitted)
    return len(merged), g, chi_squared_survival(g, free), x2, chi_squared_survival(x2, free)


def gumbel_locations(df: DataFrame, value: str, lam: float, by: list[str]) -> DataFrame:
    """mu of each group for a known lambda. Samples are shifted to their group's least, so that no power overflows; null groups are left out."""
    x = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    shifted = x.join(x.groupBy(*by).agg(F.min("x").alias("_low")), by)
    sums = shifted.groupBy(*by).agg(F.min("_low").alias("_low"), F.avg(F.exp(-F.lit(lam) * (F.col("x") - F.col("_low")))).alias("_m"))
    return sums.select(*by, (F.col("_low") - F.log("_m") / lam).alias("mu"))


def binned(df: DataFrame, value: str, *, bins: int = 8192, below: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(means, counts) of the samples in `bins` equal steps of their range: a summary whose size is fixed, for likelihoods without sufficient sums.

    Each bin is taken at the mean of its samples, so a log-likelihood errs by its curvature times the
    square of a step only. `below` drops smaller samples.
    """
    x = _samples(df, value) if below is None else _samples(df, value).where(F.col("x") >= below)
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None or low == high:
        raise ValueError("two different samples are needed")
    step = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1))
    rows = x.groupBy(step.alias("k")).agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()  # at most `bins` rows
    return np.array([r["m"] for r in rows]), np.array([r["n"] for r in rows], float)


def minimise(f: Callable[[np.ndarray], float], start: Sequence[float], *, step: float = 0.2, tolerance: float = 1e-10, most_steps: int = 4000) -> np.ndarray:
    """A local minimum of f by the downhill simplex; f may return inf outside its domain."""
    points = [np.asarray(start, float)]
    for k in range(len(start)):
        p = points[0].copy()
        p[k] += step * (abs(p[k]) or 1.0)
        points.append(p)
    valued = [(f(p), p) for p in points]
    for _ in range(most_steps):
        valued.sort(key=lambda v: v[0])
        (best, top), (worst, bottom) = valued[0], valued[-1]
        if worst - best <= tolerance * (abs(best) + tolerance) and np.allclose(top, bottom, rtol=1e-8, atol=1e-12):
            break
        centre = np.mean([p for _, p in valued[:-1]], axis=0)
        tried = centre + (centre - bottom)
        t = f(tried)
        if t < best:
            further = centre + 2 * (centre - bottom)
            u = f(further)
            valued[-1] = (u, further) if u < t else (t, tried)
        elif t < valued[-2][0]:
            valued[-1] = (t, tried)
        else:
            inner = centre + 0.5 * ((tried if t < worst else bottom) - centre)
            u = f(inner)
            if u < min(t, worst):
                valued[-1] = (u, inner)
            else:
                valued = [valued[0]] + [(f(q), q) for q in (top + 0.5 * (p - top) for _, p in valued[1:])]
    return min(valued, key=lambda v: v[0])[1]


def fit_gumbel_truncated(df: DataFrame, value: str, phi: float) -> tuple[float, float]:
    """(mu, lambda) from the samples >= phi when nothing is known of those below it."""
    x, n = binned(df, value, below=phi)
    mean = float((x * n).sum() / n.sum())
    sd = math.sqrt(float((n * (x - mean) ** 2).sum() / n.sum()))

    def loss(w: np.ndarray) -> float:
        mu, lam = mean + sd * w[0], math.exp(min(w[1], 50)) / sd
        y = lam * (x - mu)
        if not np.isfinite(y).all() or y.min() < -500:
            return math.inf
        beyond = -math.expm1(-math.exp(-lam * (phi - mu))) if lam * (phi - mu) > -500 else 1.0
        if beyond <= 0:
            return math.inf
        return -float((n * (math.log(lam) - y - np.exp(-y))).sum() / n.sum()) + math.log(beyond)

    w = minimise(loss, [-0.5, 0.2])
    return mean + sd * float(w[0]), math.exp(float(w[1])) / sd


def fit_gev(df: DataFrame, value: str) -> tuple[float, float, float]:
    """(mu, lambda, alpha) of a generalised extreme-value distribution; alpha near 0 is the Gumbel."""
    x, n = binned(df, value)
    mean = float((x * n).sum() / n.sum())
    sd = math.sqrt(float((n * (x - mean) ** 2).sum() / n.sum()))

    def loss(w: np.ndarray) -> float:
        lam, alpha = math.exp(min(w[1], 50)) / sd, float(w[2])
        y = lam * (x - mean - sd * w[0])
        if abs(alpha) < 1e-9:
            t = y
        else:
            inside = 1 + alpha * y
            if inside.min() <= 0:
                return math.inf
            t = np.log(inside) / alpha
        if t.min() < -500:
            return math.inf
        return -float((n * (math.log(lam) - (1 + alpha) * t - np.exp(-t))).sum() / n.sum())

    w = minimise(loss, [-0.45, 0.25, 0.01], step=0.1)
    return mean + sd * float(w[0]), math.exp(float(w[1])) / sd, float(w[2])


def fit_stretched(df: DataFrame, value: str, mu: float = 0.0) -> tuple[float, float]:
    """(lambda, tau) of a stretched exponential for known mu."""
    x, n = binned(df, value, below=mu)
    x, mean = x - mu, float(((x - mu) * n).sum() / n.sum())

    def loss(w: np.ndarray) -> float:
        if abs(w[0]) > 50 or abs(w[1]) > 5:
            return math.inf
        lam, tau = math.exp(w[0]) / mean, math.exp(w[1])
        return -(math.log(lam * tau) - math.lgamma(1 / tau)) + float((n * (lam * x) ** tau).sum() / n.sum())

    w = minimise(loss, [0.0, 0.0])
    return math.exp(float(w[0])) / mean, math.exp(float(w[1]))


def fit_hyperexponential(df: DataFrame, value: str, mu: float = 0.0, *, parts: int = 2, most_steps: int = 2000) -> list[tuple[float, float]]:
    """(weight, lambda) of each part, the fastest last, by expectation and maximisation for known mu."""
    x, n = binned(df, value, below=mu)
    x = np.maximum(x - mu, 0.0)
    q, lam = np.full(parts, 1 / parts), float(n.sum() / (x * n).sum()) * 4.0 ** (np.arange(parts) - (parts - 1) / 2)
    before = -math.inf
    for _ in range(most_steps):
        logs = np.log(np.maximum(q * lam, 1e-300)) - np.outer(x, lam)
        top = logs.max(axis=1, keepdims=True)
        share = np.exp(logs - top)
        total = share.sum(axis=1, keepdims=True)
        now = float((n * (np.log(total) + top)[:, 0]).sum() / n.sum())
        held = (share / total) * n[:, None]
        q, lam = held.sum(axis=0) / n.sum(), held.sum(axis=0) / np.maximum((held * x[:, None]).sum(axis=0), 1e-300)
        if now - before < 1e-12:
            break
        before = now
    order = np.argsort(lam)
    return [(float(q[k]), float(lam[k])) for k in order]


def fit_dirichlet_mixture(df: DataFrame, counts: str, parts: int, *, rounds: int = 100, tolerance: float = 1e-7, seed: int = 1) -> tuple[list[tuple[float, list[float]]], list[float]]:
    """[(weight, alpha), ...] of a mixture of Dirichlet priors for arrays of whole counts, and the log-likelihood before each round.

    Each round is one pass: tasks sum the shares of the parts and the terms of a fixed-point step that
    cannot lower the likelihood; one number per parameter is summed over tasks. Nulls and empty counts
    are left out; arrays must be equally long.
    """
    rows = df.select(F.col(counts).cast("array<long>").alias("c")).where(F.expr("c IS NOT NULL AND aggregate(c, 0L, (a, x) -> a + x) > 0"))
    each = rows.select(F.posexplode("c").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()  # one row per symbol
    if not each:
        raise ValueError("no counts")
    mean = np.array([r["n"] for r in each], float) + 1
    mean, size = mean / mean.sum(), len(each)
    rng = np.random.default_rng(seed)
    alphas, weights = mean * size * rng.uniform(0.5, 1.5, (parts, size)), np.full(parts, 1 / parts)

    def summed(weights: np.ndarray, alphas: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + parts * (size + 2))
            for batch in batches:
                if len(batch):
                    total += expected(np.array(batch["c"].tolist(), dtype=np.int64))
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        def expected(c: np.ndarray) -> np.ndarray:
            # ln Gamma(a + n) - ln Gamma(a) and its derivative are sums over 0 .. n - 1, looked up by n
            n = c.sum(axis=1)
            logs, steps, wholes = np.empty((len(c), parts)), np.empty((parts, len(c), size)), np.empty((parts, len(c)))
            with np.errstate(divide="ignore"):
                for q in range(parts):
                    log = np.log(weights[q])
                    for k in (*range(size), None):
                        a, at = (alphas[q].sum(), n) if k is None else (alphas[q, k], c[:, k])
                        up = a + np.arange(at.max())
                        gained = np.concatenate([[0.0], np.cumsum(np.log(up))])[at]
                        slope = np.concatenate([[0.0], np.cumsum(1 / up)])[at]
                        if k is None:
                            log, wholes[q] = log - gained, slope
                        else:
                            log, steps[q, :, k] = log + gained, slope
                    logs[:, q] = log
            top = logs.max(axis=1, keepdims=True)
            share = np.exp(logs - top)
            whole = share.sum(axis=1, keepdims=True)
            share /= whole
            out = [np.array([(top + np.log(whole)).sum()])]
            for q in range(parts):
                out += [np.array([share[:, q].sum(), share[:, q] @ wholes[q]]), share[:, q] @ steps[q]]
            return np.concatenate(out)

        return run

    history: list[float] = []
    for _ in range(rounds):
        found = rows.mapInPandas(summed(weights, alphas), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row per parameter
        total = np.zeros(1 + parts * (size + 2))
        for r in found:
            total[r["k"]] = r["v"]
        history.append(float(total[0]))
        table = total[1:].reshape(parts, size + 2)
        weights = table[:, 0] / table[:, 0].sum()
        alphas = np.maximum(alphas * table[:, 2:] / np.maximum(table[:, 1:2], 1e-300), 1e-8)
        if len(history) > 1 and history[-1] - history[-2] < tolerance * abs(history[-1]):
            break
    return [(float(w), a.tolist()) for w, a in zip(weights, alphas)], history
