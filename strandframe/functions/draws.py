"""Repeatable draws: each is a digest of a seed and the row's keys, so a task that runs again gives the same rows, no generator's state passes from row to row, and any SQL engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that make a draw; as bits they fit a double without loss.
DIGITS = 13
RANGE = 1 << 4 * DIGITS


def draw(seed: int, *keys: Column) -> Column:
    """A long in [0, RANGE) from the MD5 digest of the seed and the keys as text, joined by colons. A null key counts as empty text."""
    parts = [F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *keys) / F.lit(float(RANGE))
