"""Matrices in long form (i, j, v) with missing cells as zeros, and small rate matrices of substitution models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product: an equi-join on the inner index, summed before the shuffle by cell."""
    left = a.select("i", F.col("j").alias("_k"), F.col("v").alias("_x"))
    right = b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_y"))
    return left.join(right, "_k").groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def combined(a: DataFrame, b: DataFrame, x: float = 1.0, y: float = 1.0) -> DataFrame:
    """x a + y b."""
    both = a.select("i", "j", (F.col("v") * x).alias("v")).unionByName(b.select("i", "j", (F.col("v") * y).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def statistics(a: DataFrame) -> DataFrame:
    """total, least, most, trace and norm (root of the sum of squares) of the cells that are there."""
    return a.agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)).alias("trace"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def normalised_rows(a: DataFrame) -> DataFrame:
    """Each row divided by its sum; rows that sum to zero are left out."""
    sums = a.groupBy("i").agg(F.sum("v").alias("_s")).where("_s <> 0")
    return a.join(sums, "i").select("i", "j", (F.col("v") / F.col("_s")).alias("v"))


def _per_matrix(a: DataFrame, by: Sequence[str], make: Callable[[np.ndarray, list], list[tuple]], names: Sequence[str], kinds: str) -> DataFrame:
    """`make` of each matrix, square over the labels of both sides. A matrix is held by one task, so it must fit there; its size is that of the labels, not of the rows they came from."""
    keys = list(by)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        labels = sorted(set(part["i"]) | set(part["j"]))
        at = {x: k for k, x in enumerate(labels)}
        full = np.zeros((len(labels), len(labels)))
        np.add.at(full, (part["i"].map(at).to_numpy(), part["j"].map(at).to_numpy()), part["v"].to_numpy(float))
        head = tuple(part[k].iloc[0] for k in keys)
        return pd.DataFrame([(*head, *row) for row in make(full, labels)], columns=[*keys, *names])

    kept = a.select(*keys, "i", "j", F.col("v").cast("double").alias("v")).where("i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL")
    heads = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.groupBy(*keys).applyInPandas(run, f"{heads}, {kinds.format(i=kept.schema['i'].dataType.simpleString())}")


def inverse(a: DataFrame, by: Sequence[str]) -> DataFrame:
    """The inverse of the matrix of each group `by`, as (by, i, j, v); a singular one has no row."""

    def make(full: np.ndarray, labels: list) -> list[tuple]:
        if np.linalg.matrix_rank(full) < len(full):
            return []
        return [(x, y, float(v)) for x, row in zip(labels, np.linalg.inv(full)) for y, v in zip(labels, row)]

    return _per_matrix(a, by, make, ("i", "j", "v"), "i {i}, j {i}, v double")


def eigenvalues(a: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, k, v): the eigenvalues of the symmetric matrix of each group, the largest first; one that is not symmetric has no row."""

    def make(full: np.ndarray, labels: list) -> list[tuple]:
        if not np.allclose(full, full.T):
            return []
        return [(k + 1, float(v)) for k, v in enumerate(np.linalg.eigvalsh(full)[::-1])]

    return _per_matrix(a, by, make, ("k", "v"), "k int, v double")


def rate_matrix(exchange: Sequence[Sequence[float]], frequencies: Sequence[float]) -> np.ndarray:
    """Rates of a reversible model: exchangeabilities times target frequencies, rows summing to zero, one change per unit of time."""
    s, p = np.asarray(exchange, dtype=float), np.asarray(frequencies, dtype=float)
    if s.shape != (len(p), len(p)) or not np.allclose(s, s.T) or (p < 0).any() or not np.isclose(p.sum(), 1, atol=1e-6):
        raise ValueError("a symmetric matrix and frequencies that sum to one are needed")
    q = s * p
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    speed = -(p * np.diag(q)).sum()
    if speed <= 0:
        raise ValueError("no change at all")
    return q / speed


def two_rate_model(frequencies: Sequence[float], ratio: float = 1.0) -> np.ndarray:
    """Nucleotides A, C, G, T with transitions `ratio` times as fast as transversions; even frequencies and ratio 1 give the one-parameter model."""
    s = np.ones((4, 4))
    s[0, 2] = s[2, 0] = s[1, 3] = s[3, 1] = ratio
    return rate_matrix(s, frequencies)


def probabilities(rates: np.ndarray, time: float) -> np.ndarray:
    """exp(rates x time), by a Taylor series on a halved matrix that is squared again."""
    a = np.asarray(rates, dtype=float) * time
    halvings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(axis=1).max(), 1e-300)))) + 4)
    a = a / 2**halvings
    out, term = np.eye(len(a)), np.eye(len(a))
    for k in range(1, 20):
        term = term @ a / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def substitution_table(spark: SparkSession, rates: np.ndarray, symbols: str, times: Sequence[float]) -> DataFrame:
    """time, a, b, p: the probability that a has become b; a few hundred cells a time."""
    rows = [(float(t), a, b, float(p[i, j])) for t in times for p in [probabilities(rates, t)] for i, a in enumerate(symbols) for j, b in enumerate(symbols)]
    return spark.createDataFrame(rows, "time double, a string, b string, p double")
