"""Forms of distributions against each other, and matrices against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import families as f
from strandframe.operators import matrices

FAMILIES = {
    "exponential": f.exponential(1.0, 0.5), "gumbel": f.gumbel(2.0, 0.7), "frechet": f.extreme_value(1.0, 0.5, 0.3), "bounded": f.extreme_value(1.0, 0.5, -0.3),
    "weibull": f.weibull(0.5, 0.8, 1.7), "gamma": f.gamma(0.0, 1.5, 2.5), "stretched": f.stretched(0.0, 0.9, 1.6), "normal": f.normal(3.0, 2.0), "lognormal": f.lognormal(0.3, 0.8),
    "hyperexponential": f.hyperexponential(0.0, [(0.3, 0.2), (0.7, 2.0)]), "mixture": f.extreme_value_mixture([(0.4, 1.0, 0.6, 0.2), (0.6, 4.0, 1.0, 0.0)]), "chi_squared": f.chi_squared(3),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_forms_agree(spark, name):
    family, step = FAMILIES[name], 1e-4
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in (0.7, 1.3, 2.1, 3.9, 5.5)] + [(-200.0,), (None,)], "x double")
    rows = df.select(x, family.pdf(x).alias("pdf"), family.log_pdf(x).alias("log_pdf"), family.cdf(x).alias("cdf"), family.survival(x).alias("up"), family.log_cdf(x).alias("log_cdf"), family.log_survival(x).alias("log_up"), family.cdf(x + step).alias("right"), family.cdf(x - step).alias("left")).withColumn("back", family.inverse(F.when((F.col("cdf") > 0) & (F.col("cdf") < 1), F.col("cdf")))).collect()
    for r in rows[:5]:
        assert math.isclose(r.cdf + r.up, 1, abs_tol=1e-9) and math.isclose((r.right - r.left) / (2 * step), r.pdf, rel_tol=1e-4, abs_tol=1e-6)
        if r.cdf > 0:
            assert math.isclose(math.log(r.cdf), r.log_cdf, abs_tol=1e-8)
        if 0 < r.cdf < 1:
            assert math.isclose(math.log(r.up), r.log_up, rel_tol=1e-7, abs_tol=1e-8) and math.isclose(r.back, r.x, rel_tol=1e-6)
    assert rows[5].cdf < 1e-9 and rows[5].pdf < 1e-9 and rows[6].cdf is None and rows[6].log_pdf is None
    got = spark.range(4000).select(family.sample(5).alias("x")).select(F.avg((x <= 2.1).cast("double")).alias("share")).first().share
    assert abs(got - rows[2].cdf) < 0.04


def test_tails_keep_their_digits(spark):
    row = spark.range(1).select(FAMILIES["gumbel"].log_survival(F.lit(80.0)).alias("g"), FAMILIES["exponential"].log_survival(F.lit(5000.0)).alias("e"), f.g_test_p(F.lit(3.841458820694124)).alias("p")).first()
    assert math.isclose(row.g, -0.7 * 78, rel_tol=1e-9) and row.e == -2499.5 and math.isclose(row.p, 0.05, rel_tol=1e-6)


def test_long_matrices(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(4, 5)), rng.normal(size=(5, 3))
    long = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")
    dense = lambda df, shape: np.array([[{(r.i, r.j): r.v for r in rows}.get((i, j), 0) for j in range(shape[1])] for rows in [df.collect()] for i in range(shape[0])])
    assert np.allclose(dense(matrices.product(long(a), long(b)), (4, 3)), a @ b) and np.allclose(dense(matrices.transposed(long(a)), (5, 4)), a.T)
    assert np.allclose(dense(matrices.combined(long(a), long(a), 2.0, -0.5), (4, 5)), 1.5 * a)
    s = matrices.statistics(long(a)).first()
    assert np.allclose([s.total, s.least, s.most, s.trace, s.norm], [a.sum(), a.min(), a.max(), np.trace(a), np.linalg.norm(a)])
    assert np.allclose(dense(matrices.normalised_rows(long(abs(a))), (4, 5)).sum(axis=1), 1)


def test_rates_and_probabilities(spark):
    even = matrices.two_rate_model([0.25] * 4)
    assert np.allclose(np.diag(even), -1) and np.allclose(np.diag(matrices.probabilities(even, 0.6)), 0.25 + 0.75 * math.exp(-0.8))
    p = [0.1, 0.2, 0.3, 0.4]
    rates = matrices.two_rate_model(p, 4.0)
    much = matrices.probabilities(rates, 500.0)
    assert np.allclose(much, [p] * 4) and np.allclose(matrices.probabilities(rates, 0.3) @ matrices.probabilities(rates, 0.5), matrices.probabilities(rates, 0.8))
    table = matrices.substitution_table(spark, rates, "ACGT", [0.0, 1.0])
    assert table.count() == 32 and table.where("time = 0 AND a = b AND p = 1").count() == 4
    with pytest.raises(ValueError):
        matrices.rate_matrix([[0, 1], [2, 0]], [0.5, 0.5])


def test_inverses_and_eigenvalues(spark):
    rng = np.random.default_rng(6)
    full = {"a": rng.normal(size=(5, 5)), "b": np.ones((3, 3))}
    rows = [(g, int(i), int(j), float(m[i, j])) for g, m in full.items() for i, j in np.ndindex(m.shape)]
    df = spark.createDataFrame(rows, "g string, i long, j long, v double")
    got = matrices.inverse(df, ["g"]).collect()
    back = np.zeros((5, 5))
    for r in got:
        back[r.i, r.j] = r.v
    assert {r.g for r in got} == {"a"} and full["a"] @ back == pytest.approx(np.eye(5), abs=1e-9)  # the other is singular
    values = matrices.eigenvalues(df, ["g"]).collect()
    assert {r.g for r in values} == {"b"} and [r.v for r in sorted(values, key=lambda r: r.k)] == pytest.approx([3, 0, 0], abs=1e-9)
    assert matrices.inverse(df.limit(0), ["g"]).isEmpty()
