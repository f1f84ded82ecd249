"""Maps between the columns of two alignments of the same sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.annotation import GAPS


def shared_residues(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aln, i, j, n): how many residues column i of `a` shares with column j of `b`; both are long tables (aln, key, col, res).

    Residues meet by their number within the row. Both rows of a key are gathered by one shuffle, so neither table is joined, or broadcast, and the counts combine before the next one.
    """

    def side(res: DataFrame, second: bool) -> DataFrame:
        return res.where(~F.col("res").isin(*GAPS) & F.col("aln").isNotNull() & F.col("key").isNotNull()).select("aln", "key", "col", F.lit(second).alias("_second"))

    columns = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("col"))))
    rows = side(a, False).unionByName(side(b, True)).groupBy("aln", "key").agg(columns(~F.col("_second")).alias("i"), columns(F.col("_second")).alias("j"))
    met = rows.select("aln", F.explode(F.arrays_zip("i", "j")).alias("_c")).select("aln", "_c.i", "_c.j").where("i IS NOT NULL AND j IS NOT NULL")
    return met.groupBy("aln", "i", "j").agg(F.count("*").alias("n"))


def best_chain(cells: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Cells (i, j, n) with rising i and j and the greatest sum of n. Ties prefer the chain found first by i, then j.

    A tree of prefix maxima over j gives it in n log n of the nonempty cells, not of all pairs of columns.
    """
    cells = sorted(cells)
    width = max((j for _, j, _ in cells), default=0)
    tree: list[tuple[int, int]] = [(0, -1)] * (width + 1)  # (sum, cell) by prefix of j
    total, back = [0] * len(cells), [-1] * len(cells)

    def ahead(j: int) -> tuple[int, int]:
        best = (0, -1)
        while j > 0:
            if tree[j][0] > best[0]:
                best = tree[j]
            j -= j & -j
        return best

    k = 0
    while k < len(cells):
        end = k
        while end < len(cells) and cells[end][0] == cells[k][0]:
            before, back[end] = ahead(cells[end][1] - 1)
            total[end] = before + cells[end][2]
            end += 1
        for at in range(k, end):  # cells of one i cannot follow each other
            j = cells[at][1]
            while j <= width:
                if total[at] > tree[j][0]:
                    tree[j] = (total[at], at)
                j += j & -j
        k = end
    at = int(np.argmax(total)) if total else -1
    chain = []
    while at >= 0:
        chain.append(cells[at])
        at = back[at]
    return chain[::-1]


def column_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aln, i, j, n): the columns of `a` and `b` that correspond, in order, so that the most residues are shared.

    Only counts per pair of columns reach the chaining step, one alignment at a time: as many as
    pairs of columns that share a residue, whatever the number of rows.
    """

    def run(found: pd.DataFrame) -> pd.DataFrame:
        chain = best_chain(list(zip(found["i"].tolist(), found["j"].tolist(), found["n"].tolist())))
        return pd.DataFrame([(found["aln"].iloc[0], *c) for c in chain], columns=["aln", "i", "j", "n"])

    met = shared_residues(a, b)
    kind = dict(met.dtypes)["aln"]
    return met.groupBy("aln").applyInPandas(run, f"aln {kind}, i int, j int, n long")
