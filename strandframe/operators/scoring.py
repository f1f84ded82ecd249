"""Substitution scores: counts from alignments, log-odds, scales, expectations and implied frequencies.

Counting is distributed; a matrix has as many cells as pairs of symbols, so solving for its scale is done on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def substitution_counts(columns: DataFrame) -> DataFrame:
    """(a, b, n), a <= b: pairs of residues of all pairs of rows, from column counts (aln, col, res, n).

    A column of n_a and n_b residues holds n_a n_b pairs of different ones and n_a (n_a - 1) / 2 equal ones,
    so rows are never paired: a column has at most one row per symbol.
    """
    counts = columns.groupBy("aln", "col").agg(F.collect_list(F.struct("res", "n")).alias("c"))
    x = counts.select(F.explode("c").alias("x"), "c").select("x", F.explode("c").alias("y")).where("x.res <= y.res")
    n = F.when(F.col("x.res") == F.col("y.res"), F.col("x.n") * (F.col("x.n") - 1) / 2).otherwise(F.col("x.n") * F.col("y.n"))
    return x.groupBy(F.col("x.res").alias("a"), F.col("y.res").alias("b")).agg(F.sum(n.cast("long")).alias("n")).where("n > 0")


def log_odds(counts: DataFrame) -> DataFrame:
    """(a, b, n, odds) of pair counts: odds is log2 of the pair's share over that of chance pairing of the same residues."""
    halves = counts.select(F.explode(F.array("a", "b")).alias("s"), "n").groupBy("s").agg((F.sum("n") / 2).alias("m"))
    total = counts.agg(F.sum("n").alias("t"))
    one = lambda c: halves.select(F.col("s").alias(c), F.col("m").alias(f"_{c}"))
    met = counts.join(F.broadcast(one("a")), "a").join(F.broadcast(one("b")), "b").crossJoin(F.broadcast(total))  # one row per symbol, and one row
    chance = F.col("_a") * F.col("_b") / F.col("t") * F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return met.select("a", "b", "n", F.log2(F.col("n") / chance).alias("odds"))


def expected_score(cells: DataFrame, background: DataFrame) -> DataFrame:
    """One row, `expected`: the mean score of a chance pair. `cells` is (a, b, score) over all ordered pairs, `background` is (s, p)."""
    one = lambda c: background.select(F.col("s").alias(c), F.col("p").alias(f"_{c}"))
    return cells.join(F.broadcast(one("a")), "a").join(F.broadcast(one("b")), "b").agg(F.sum(F.col("score") * F.col("_a") * F.col("_b")).alias("expected"))


def _root(f, low: float, high: float) -> float:
    """Where f changes sign; both ends must differ in it."""
    positive = f(high) > 0
    if (f(low) > 0) == positive:
        raise ValueError("no change of sign")
    while high - low > 1e-13 * max(1.0, high):
        middle = (low + high) / 2
        if (f(middle) > 0) == positive:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def scale(scores: np.ndarray, background: Sequence[float]) -> float:
    """The lambda > 0 at which chance pairs have sum p_a p_b exp(lambda s_ab) = 1. The mean score must be negative and some score positive."""
    s, p = np.asarray(scores, float), np.asarray(background, float)
    pp = np.outer(p, p)
    if (s * pp).sum() >= 0 or s[pp > 0].max() <= 0:
        raise ValueError("the mean score must be negative and some score positive")
    f = lambda lam: float((pp * np.exp(lam * s)).sum() - 1)
    high = 1.0 / s.max()
    while f(high) <= 0:
        high *= 2
    low = high
    while f(low) > 0:
        low /= 2
    return _root(f, low, high)


def relative_entropy(scores: np.ndarray, background: Sequence[float], lam: float | None = None) -> float:
    """Bits per pair of the frequencies that the scores imply, over chance."""
    s, p = np.asarray(scores, float), np.asarray(background, float)
    lam = scale(s, p) if lam is None else lam
    pp = np.outer(p, p)
    return float((pp * np.exp(lam * s) * lam * s).sum() / np.log(2))


def implied_background(scores: np.ndarray) -> tuple[float, np.ndarray]:
    """(lambda, p) of a symmetric matrix alone: p is the row sums of the inverse of exp(lambda s), and lambda makes them sum to one."""
    s = np.asarray(scores, float)
    if not np.allclose(s, s.T):
        raise ValueError("the matrix is not symmetric")
    rest = lambda lam: float(np.linalg.inv(np.exp(lam * s)).sum() - 1)
    grid = np.geomspace(1e-3, 20, 400) / np.abs(s).max()
    for low, high in zip(grid[::-1][1:], grid[::-1]):
        if (rest(low) > 0) != (rest(high) > 0):
            lam = _root(rest, low, high)
            p = np.linalg.inv(np.exp(lam * s)).sum(axis=1)
            if (p > 0).all() and abs(p.sum() - 1) < 1e-6:
                return lam, p
    raise ValueError("the scores imply no frequencies")


def as_matrix(cells: Sequence[tuple[str, str, float]]) -> tuple[list[str], np.ndarray]:
    """Symbols in their first order, and the square matrix of (a, b, score) cells."""
    symbols = list(dict.fromkeys(a for a, _, _ in cells))
    at: Mapping[str, int] = {s: i for i, s in enumerate(symbols)}
    out = np.zeros((len(symbols), len(symbols)))
    for a, b, v in cells:
        out[at[a], at[b]] = v
    return symbols, out
