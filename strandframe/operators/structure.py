"""Base pairs: bracket notation to pairs, comparison, counts and mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENING = "<([{"
CLOSING = ">)]}"


def bracket_pairs(structure: str, *, knots: bool = True) -> list[tuple[int, int]]:
    """1-based (i, j), i < j. Letters are knotted pairs: capital opens, small closes. Unbalanced marks raise ValueError."""
    stacks: dict[str, list[int]] = {}
    out = []
    for at, c in enumerate(structure, 1):
        kind = None
        if c in OPENING:
            # all four brackets nest in one another
            stacks.setdefault("nested", []).append(at)
        elif c in CLOSING:
            kind = "nested"
            if stacks.get(kind) and OPENING.index(structure[stacks[kind][-1] - 1]) != CLOSING.index(c):
                raise ValueError(f"brackets of different kinds at {at}")
        elif c.isascii() and c.isalpha() and knots:
            if c.isupper():
                stacks.setdefault(c, []).append(at)
            else:
                kind = c.upper()
        if kind:
            if not stacks.get(kind):
                raise ValueError(f"nothing to close at {at}")
            out.append((stacks[kind].pop(), at))
    if any(stacks.values()):
        raise ValueError("open brackets at the end")
    return sorted(out)


def pairs_to_brackets(pairs: list[tuple[int, int]], n: int) -> str:
    """Nested pairs as <>; a pair that crosses one before it gets letters."""
    out, placed = ["."] * n, []
    knots: list[list[tuple[int, int]]] = []
    for i, j in sorted(pairs):
        crosses = lambda p: p[0] < i < p[1] < j or i < p[0] < j < p[1]
        if not any(map(crosses, placed)):
            placed.append((i, j))
            out[i - 1], out[j - 1] = "<", ">"
            continue
        level = next((k for k, group in enumerate(knots) if not any(map(crosses, group))), len(knots))
        if level == len(knots):
            knots.append([])
        if level >= 26:
            raise ValueError("more than 26 levels of knots")
        knots[level].append((i, j))
        out[i - 1], out[j - 1] = chr(65 + level), chr(97 + level)
    return "".join(out)


def pair_table(df: DataFrame, key: str, structure: str, *, knots: bool = True) -> DataFrame:
    """(key, i, j) of each structure; parsing needs a stack, so it runs in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: [{"i": i, "j": j} for i, j in bracket_pairs(s or "", knots=knots)])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    parse = F.pandas_udf(run, returnType="array<struct<i:int,j:int>>")
    return df.select(F.col(key), F.explode(parse(F.col(structure))).alias("_p")).select(key, "_p.*")


def compare(known: DataFrame, predicted: DataFrame, key: str, *, relaxed: bool = False) -> DataFrame:
    """For each key: n_known, n_predicted, found, right, sensitivity, ppv. `relaxed` also accepts a pair with one end off by one. All sides have a row per pair or key, so none is broadcast."""
    shifts = [(0, 0)] + ([(1, 0), (-1, 0), (0, 1), (0, -1)] if relaxed else [])
    near = lambda df: df.select(key, F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in shifts])).alias("_s"), F.col("i").alias("_i"), F.col("j").alias("_j")).select(key, "_s.*", "_i", "_j")

    def counted(of: DataFrame, other: DataFrame, total: str, hits: str) -> DataFrame:
        met = near(of).join(other.select(key, "i", "j").distinct().hint("merge"), [key, "i", "j"], "left_semi").groupBy(key).agg(F.count_distinct("_i", "_j").alias(hits))
        return of.groupBy(key).agg(F.count("*").alias(total)).join(met.hint("merge"), key, "left").select(key, total, F.coalesce(hits, F.lit(0)).cast("long").alias(hits))

    both = counted(known, predicted, "n_known", "found").join(counted(predicted, known, "n_predicted", "right").hint("merge"), key, "full_outer")
    filled = both.na.fill(0, ["n_known", "found", "n_predicted", "right"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return filled.select(key, "n_known", "n_predicted", "found", "right", share("found", "n_known").alias("sensitivity"), share("right", "n_predicted").alias("ppv"))


def pair_counts(res: DataFrame, pairs: DataFrame, *, gap: str = "-") -> DataFrame:
    """n of each residue pair (a, b) at each paired pair of columns (aln, i, j). `pairs` is a consensus structure, one row per pair of columns.

    The residues of both columns have a row per row of the alignment, which Spark takes for far less after an explode; the hints keep it from broadcasting one through the driver.
    """
    left = res.where(F.col("res") != gap).select("aln", "key", F.col("col").alias("i"), F.col("res").alias("a"))
    right = res.where(F.col("res") != gap).select("aln", "key", F.col("col").alias("j"), F.col("res").alias("b"))
    paired = lambda df, col: df.join(pairs.select("aln", col).distinct(), ["aln", col], "left_semi")  # noqa: E731 - only paired columns are shuffled
    left, right = paired(left, "i"), paired(right, "j")
    return left.join(pairs.hint("merge"), ["aln", "i"]).join(right.hint("merge"), ["aln", "key", "j"]).groupBy("aln", "i", "j", "a", "b").agg(F.count("*").alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """n and mi (bits) of each pair of columns from pair counts, by sums of x log2 x, so that no row is joined back."""
    term = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0))
    by = ["aln", "i", "j"]
    both = counts.groupBy(*by).agg(term("n").alias("_ab"), F.sum("n").alias("n"))
    one = lambda c, name: counts.groupBy(*by, c).agg(F.sum("n").alias("_m")).groupBy(*by).agg(term("_m").alias(name))
    joined = both.join(one("a", "_a"), by).join(one("b", "_b"), by)
    n: Column = F.col("n")
    return joined.select(*by, "n", ((F.col("_ab") - F.col("_a") - F.col("_b")) / n + F.log2(n)).alias("mi"))


def pair_support(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(aln, i, j, n, share): in how many rows' own structures each pair stands. `pairs` is (aln, key, i, j), `rows` one row per row of the alignments (aln, ...)."""
    sizes = rows.groupBy("aln").agg(F.count("*").alias("_all"))
    return pairs.groupBy("aln", "i", "j").agg(F.count("*").alias("n")).join(sizes, "aln").select("aln", "i", "j", "n", (F.col("n") / F.col("_all")).alias("share"))


def _ends(support: DataFrame) -> DataFrame:
    return support.select("aln", "n", "share", F.explode(F.array(F.struct(F.col("i").alias("col"), F.col("j").alias("to")), F.struct(F.col("j").alias("col"), F.col("i").alias("to")))).alias("_e")).select("aln", "n", "share", "_e.*")


def conflicts(support: DataFrame) -> DataFrame:
    """(aln, col, n_partners) of columns that pair with more than one other."""
    return _ends(support).groupBy("aln", "col").agg(F.count("*").alias("n_partners")).where("n_partners > 1")


def least_share(support: DataFrame) -> DataFrame:
    """(aln, share): the pairs of more than this share conflict nowhere, and no lower share does that: the second greatest share of any column, or 0."""
    two = _ends(support).groupBy("aln", "col").agg(F.slice(F.sort_array(F.collect_list("share"), asc=False), 2, 1).alias("_s"))  # a column has at most as many partners as there are columns
    return two.groupBy("aln").agg(F.coalesce(F.max(F.get("_s", F.lit(0))), F.lit(0.0)).alias("share"))


def consistent_pairs(support: DataFrame, share: float | None = None) -> DataFrame:
    """(aln, i, j, n, share) of a structure that all rows agree on: pairs of more than `share` of the rows (by default the least share that works) whose columns have no other such partner."""
    if share is None:
        chosen = support.join(least_share(support).withColumnRenamed("share", "_least"), "aln").where("share > _least").drop("_least")
    else:
        chosen = support.where(F.col("share") > share)
    bad = conflicts(chosen).select("aln", "col")
    return chosen.join(bad.withColumnRenamed("col", "i"), ["aln", "i"], "left_anti").join(bad.withColumnRenamed("col", "j"), ["aln", "j"], "left_anti").select("aln", "i", "j", "n", "share")
