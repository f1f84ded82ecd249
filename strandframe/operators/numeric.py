"""Statistics of sample columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, width: float, *, by: list[str] | None = None, origin: float = 0.0) -> DataFrame:
    """bin, lo, hi, obs: bins are open on the left and closed on the right, (lo, hi]."""
    b = F.ceil((F.col(value) - origin) / width - 1).cast("long").alias("bin")
    counts = df.where(F.col(value).isNotNull()).groupBy(*(by or []), b).agg(F.count("*").alias("obs"))
    return counts.select(*(by or []), "bin", (F.col("bin") * F.lit(width) + origin).alias("lo"), ((F.col("bin") + 1) * F.lit(width) + origin).alias("hi"), "obs")


def survival(bins: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """bin, lo, surv: the share of samples above lo. Works on bins, whose number does not grow with the samples."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    above = F.sum("obs").over(w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    return bins.select(*(by or []), "bin", "lo", (above / F.sum("obs").over(w)).alias("surv"))


def tail_by_score(bins: DataFrame, least: float) -> DataFrame:
    """The whole bins that lie above `least`: phi (lower bound), n_tail, n_all."""
    return bins.agg(F.min(F.when(F.col("lo") >= least, F.col("lo"))).alias("phi"), F.coalesce(F.sum(F.when(F.col("lo") >= least, F.col("obs"))), F.lit(0)).alias("n_tail"), F.sum("obs").alias("n_all"))


def quantile_pairs(bins: DataFrame, inverse: Callable[[Column], Column]) -> DataFrame:
    """bin, hi, expected: the upper bound of each bin beside the value below which `inverse` has the same share of samples; the highest bin has none."""
    w = Window.partitionBy(F.lit(0))  # one row per bin
    share = F.sum("obs").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("obs").over(w)
    return bins.select("bin", "hi", share.alias("_p")).where("_p < 1").select("bin", "hi", inverse(F.col("_p")).alias("expected"))


def expected_counts(bins: DataFrame, cdf: Callable[[Column], Column]) -> DataFrame:
    """bin, lo, hi, obs, expected: the number of samples that a distribution would put into each bin."""
    total = F.sum("obs").over(Window.partitionBy(F.lit(0)))
    return bins.select("bin", "lo", "hi", "obs", (total * (cdf(F.col("hi")) - cdf(F.col("lo")))).alias("expected"))


def tail_by_mass(bins: DataFrame, mass: float) -> DataFrame:
    """The whole bins from the top that hold at least `mass` of the samples: phi (lower bound), n_tail, n_all."""
    w = Window.partitionBy(F.lit(0))
    cum = bins.select("lo", "obs", F.sum("obs").over(w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("obs").over(w).alias("n_all"))
    kept = cum.where(F.col("cum") - F.col("obs") < mass * F.col("n_all"))
    return kept.agg(F.min("lo").alias("phi"), F.sum("obs").alias("n_tail"), F.max("n_all").alias("n_all"))


def nth_highest(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n-th highest value; each task keeps n rows."""
    return df.where(F.col(value).isNotNull()).select(value).orderBy(F.desc(value)).limit(n).agg(F.min(value).alias("nth_value"), F.count("*").alias("n"))


def moments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, var (0 for one sample)."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) == 1, 0.0).otherwise(F.var_samp(v)).alias("var"))


def linear_regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least squares y = a + b x: a, b, r."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.corr(x, y).alias("r"))


def log_likelihood_ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """ln ratio of two binomials with k of n each against one common rate; no factor of two."""
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    one = lambda k, n: xlogx(k) + xlogx(n - k) - xlogx(n)
    return one(k1, n1) + one(k2, n2) - one(k1 + k2, n1 + n2)


def g_test(df: DataFrame, event: Column, by: str) -> DataFrame:
    """For each value of `by`: k, n, llr and g2 of its rate of `event` against the rate of all other rows."""
    counts = df.groupBy(by).agg(F.sum(event.cast("long")).alias("k"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    both = counts.withColumn("_k", F.sum("k").over(w) - F.col("k")).withColumn("_n", F.sum("n").over(w) - F.col("n"))
    d = lambda c: F.col(c).cast("double")
    return both.select(by, "k", "n", log_likelihood_ratio(d("k"), d("n"), d("_k"), d("_n")).alias("llr")).withColumn("g2", 2 * F.col("llr"))


def category_entropy(df: DataFrame, category: str, by: list[str]) -> DataFrame:
    """n_kinds, entropy (bits), rel_entropy against all rows (bits), information (log2 of all kinds, less entropy)."""
    counts = df.groupBy(*by, category).agg(F.count("*").alias("n"))
    total = counts.groupBy(category).agg(F.sum("n").alias("_q"))
    w, every = Window.partitionBy(*by), Window.partitionBy(F.lit(0))
    all_ = total.select(category, (F.col("_q") / F.sum("_q").over(every)).alias("_q"), F.count("*").over(every).alias("_kinds"))
    p = counts.withColumn("_p", F.col("n") / F.sum("n").over(w)).join(F.broadcast(all_) if len(by) == 0 else all_, category)
    return p.groupBy(*by).agg(F.count("*").alias("n_kinds"), (-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"), F.sum(F.col("_p") * F.log2(F.col("_p") / F.col("_q"))).alias("rel_entropy"), (F.max(F.log2("_kinds")) + F.sum(F.col("_p") * F.log2("_p"))).alias("information"))


def fit_exponential(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mu (least sample) and rate 1 / (mean - mu)."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.min(v).alias("mu"), F.avg(v).alias("_m")).select(*by, "mu", F.when(F.col("_m") > F.col("mu"), 1 / (F.col("_m") - F.col("mu"))).alias("rate"))


def fit_lognormal(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and sample deviation of the logarithm of the positive samples."""
    return df.where(F.col(value) > 0).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.log(value)).alias("mu"), F.stddev_samp(F.log(value)).alias("sigma"))


def fit_gumbel(df: DataFrame, value: str, *, tolerance: float = 1e-7, most_steps: int = 60) -> DataFrame:
    """mu and lambda of a complete Gumbel fit by Newton's method; each step is one aggregation, and only three sums reach the driver."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    n, mean, sd, low = x.agg(F.count("*"), F.avg("x"), F.stddev_samp("x"), F.min("x")).first()
    if not n or not sd:
        return df.sparkSession.createDataFrame([], "mu double, lambda double, n long")
    lam = 1.2825498301618641 / sd  # pi / sqrt(6) over the deviation
    for _ in range(most_steps):
        e = F.exp(-F.lit(lam) * (F.col("x") - F.lit(low)))
        s0, s1, s2 = x.agg(F.sum(e), F.sum(e * (F.col("x") - low)), F.sum(e * (F.col("x") - low) ** 2)).first()
        f = 1 / lam - (mean - low) + s1 / s0
        df_ = -1 / lam**2 - s2 / s0 + (s1 / s0) ** 2
        step = f / df_
        lam = lam - step if lam - step > 0 else lam / 2
        if abs(step) < tolerance * lam:
            break
    s0 = x.agg(F.sum(F.exp(-F.lit(lam) * (F.col("x") - F.lit(low))))).first()[0]
    import math

    return df.sparkSession.createDataFrame([(low - math.log(s0 / n) / lam, lam, n)], "mu double, lambda double, n long")
