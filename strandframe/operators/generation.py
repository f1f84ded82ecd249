"""Random sequences, weighted choices, and shuffled or resampled columns; all from the draws of `functions.draws`."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.draws import draw, uniform


def _pick(u: Column, weights: Mapping[str, float]) -> Column:
    """The first symbol whose running share exceeds u."""
    held = {s: w for s, w in weights.items() if w > 0}
    if not held or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    whole = sum(held.values())
    *most, (last, _) = zip(held, accumulate(held.values()))
    out = F
    for symbol, upto in most:
        out = out.when(u < upto / whole, symbol)
    return F.lit(last) if out is F else out.otherwise(last)


def choice(weights: Mapping[str, float], *, seed: int, key: Column) -> Column:
    """One symbol per row by weight."""
    return _pick(uniform(seed, key), weights)


def independent(spark: SparkSession, n: int, length: int, weights: Mapping[str, float], *, seed: int) -> DataFrame:
    """(id, seq): n sequences of independent symbols."""
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: _pick(uniform(seed, F.col("id"), i), weights)) if length > 0 else F.array().cast("array<string>")
    return spark.range(n).select("id", F.array_join(letters, "").alias("seq"))


def chained(spark: SparkSession, n: int, length: int, first: Mapping[str, float], after: Mapping[str, Mapping[str, float]], *, seed: int) -> DataFrame:
    """(id, seq): n sequences whose symbols depend on the one before, as `after[symbol]` weighs them."""
    if length < 1:
        return spark.range(n).select("id", F.lit("").alias("seq"))

    def step(acc: Column, i: Column) -> Column:
        u, out = uniform(seed, F.col("id"), i), F
        for symbol, weights in after.items():
            out = out.when(F.right(acc, F.lit(1)) == symbol, _pick(u, weights))
        return F.concat(acc, out)

    start = _pick(uniform(seed, F.col("id"), F.lit(1)), first)
    rest = F.sequence(F.lit(2), F.lit(length)) if length > 1 else F.array().cast("array<int>")
    return spark.range(n).select("id", F.aggregate(rest, start, step).alias("seq"))


def shuffled_windows(seq: Column, key: Column, width: int, *, seed: int) -> Column:
    """Symbols shuffled within windows of `width`, so that local composition stays."""
    at = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)))
    ranked = F.transform(at, lambda i: F.struct(F.floor(i / width).alias("w"), draw(seed, key, i).alias("h"), i.alias("i")))
    letters = F.transform(F.array_sort(ranked), lambda x: F.substr(seq, (x["i"] + 1).cast("int"), F.lit(1)))
    return F.when(seq.isNotNull(), F.array_join(letters, ""))



def _columns(aseq: Column) -> Column:
    return F.when(F.length(aseq) > 0, F.sequence(F.lit(1), F.length(aseq))).otherwise(F.array().cast("array<int>"))


def _picked(aseq: Column, columns: Column) -> Column:
    return F.when(aseq.isNotNull(), F.array_join(F.transform(columns, lambda c: F.substr(aseq, c.cast("int"), F.lit(1))), ""))


def shuffled_columns(aseq: Column, aln: Column, *, seed: int) -> Column:
    """The row with its columns in an order that all rows of alignment `aln` share. The order follows from the alignment's name and width, so no row needs another."""
    ranked = F.transform(_columns(aseq), lambda i: F.struct(draw(seed, aln, i).alias("d"), i.alias("i")))
    return _picked(aseq, F.transform(F.array_sort(ranked), lambda x: x["i"]))


def resampled_columns(aseq: Column, aln: Column, *, seed: int) -> Column:
    """A bootstrap sample: as many columns as the row has, drawn with replacement, the same for all rows of alignment `aln`."""
    return _picked(aseq, F.transform(_columns(aseq), lambda i: draw(seed, aln, i) % F.length(aseq) + 1))


def shuffled_within_columns(res: DataFrame, *, seed: int) -> DataFrame:
    """The long table (aln, key, col, res) with the symbols of each column dealt anew over the rows. An alignment's columns are apart, so its rows share no task.

    Both sides of the join have a row per residue, which Spark takes for far less after an explode; the hint keeps it from broadcasting one through the driver.
    """
    column = Window.partitionBy("aln", "col")
    key, drawn = F.row_number().over(column.orderBy("key")), F.row_number().over(column.orderBy(draw(seed, F.col("aln"), F.col("key"), F.col("col")), "key"))
    ranked = res.select("aln", "col", "key", "res", key.alias("_k"), drawn.alias("_d"))
    return ranked.select("aln", "col", "key", F.col("_k").alias("_n")).join(ranked.select("aln", "col", "res", F.col("_d").alias("_n")).hint("merge"), ["aln", "col", "_n"]).select("aln", "key", "col", "res")
