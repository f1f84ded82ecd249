"""Vectors as array<double> columns, by higher-order functions only. An empty vector gives the neutral value, a null one null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: used inside a lambda as it is, it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def total(v: Column) -> Column:
    return _sum(v)


def dot(v: Column, w: Column) -> Column:
    """Sum of products; vectors of unlike lengths give null."""
    return _sum(F.zip_with(v, w, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column | float) -> Column:
    factor = by if isinstance(by, Column) else F.lit(by)
    return F.transform(v, lambda x: x.cast("double") * factor)


def added(v: Column, w: Column, times: Column | float = 1.0) -> Column:
    """v + times * w."""
    factor = times if isinstance(times, Column) else F.lit(times)
    return F.zip_with(v, w, lambda x, y: x.cast("double") + factor * y.cast("double"))


def arg_max(v: Column) -> Column:
    """1-based place of the first greatest value; 0 for an empty vector."""
    return F.coalesce(F.array_position(v, F.array_max(v)), F.when(v.isNotNull(), F.lit(0)))


def arg_min(v: Column) -> Column:
    return F.coalesce(F.array_position(v, F.array_min(v)), F.when(v.isNotNull(), F.lit(0)))


def normalised(v: Column) -> Column:
    """Divided by the sum; a sum of zero gives equal shares."""
    return _once(_sum(v), lambda s: F.transform(v, lambda x: F.when(s != 0, x.cast("double") / s).otherwise(F.lit(1.0) / F.size(v))))


def log_sum_exp(v: Column) -> Column:
    """ln of the sum of exponentials, without overflow; -inf for an empty vector."""
    lowest = F.lit(float("-inf"))

    def shifted(top: Column) -> Column:
        terms = F.transform(v, lambda x: F.exp(x.cast("double") - top))
        return F.when(top.isNull() | (top == lowest), F.when(v.isNotNull(), lowest)).otherwise(top + F.log(_sum(terms)))

    return _once(F.array_max(v).cast("double"), shifted)


def log_normalised(v: Column) -> Column:
    """Probabilities of log weights."""
    return _once(log_sum_exp(v), lambda z: F.transform(v, lambda x: F.exp(x.cast("double") - z)))


def entropy(p: Column) -> Column:
    """Bits of a probability vector."""
    return -_sum(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def relative_entropy(p: Column, q: Column) -> Column:
    """Bits of p over q; infinite where p has what q has not."""
    return _sum(F.zip_with(p, q, lambda x, y: F.when(x <= 0, 0.0).when(y <= 0, float("inf")).otherwise(x * F.log2(x / y))))


def cumulative(v: Column) -> Column:
    """Running sums."""
    return F.aggregate(v, F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x.cast("double")))


def is_probability(v: Column, tolerance: float = 1e-6) -> Column:
    """Whether all values are between 0 and 1 and sum to one."""
    return F.forall(v, lambda x: x.between(0, 1)) & (F.abs(_sum(v) - 1) <= tolerance)
