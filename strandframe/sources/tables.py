"""Text tables: columns, score and rate matrices, genetic codes, masks, mixtures and search reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_columns(spark: SparkSession, path: str, *, comment: str = "#") -> DataFrame:
    """One row per line with fields: `fields`, split at white space; comments run to the line's end."""
    line = F.trim(F.regexp_replace("value", f"{comment}.*$", ""))
    return spark.read.text(path).select(F.regexp_replace(line, r"^\s+|\s+$", "").alias("_l")).where("_l <> ''").select(F.split("_l", r"\s+").alias("fields"))


def score_matrix(lines: Sequence[str]) -> list[tuple[str, str, float]]:
    """(a, b, score) of a matrix with a heading row of symbols, as text lines; rows may begin with their symbol or not."""
    rows = [line.split("#")[0].split() for line in lines]
    rows = [r for r in rows if r]
    if not rows:
        raise ValueError("no heading row")
    symbols, out = rows[0], []
    if len(rows) - 1 != len(symbols):
        raise ValueError(f"{len(symbols)} symbols but {len(rows) - 1} rows")
    for a, row in zip(symbols, rows[1:]):
        values = row[1:] if len(row) == len(symbols) + 1 else row
        if len(values) != len(symbols) or (len(row) > len(symbols) and row[0] != a):
            raise ValueError(f"bad row of {a}")
        out += [(a, b, float(v)) for b, v in zip(symbols, values)]
    return out


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A score matrix is a few hundred cells: parsed on the driver."""
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(score_matrix((text[0] if text else "").splitlines()), "a string, b string, score double")


def format_score_matrix(cells: Sequence[tuple[str, str, float]]) -> str:
    symbols = list(dict.fromkeys(a for a, *_ in cells))
    by = {(a, b): s for a, b, s in cells}
    lines = ["  " + " ".join(f"{b:>4}" for b in symbols)]
    return "\n".join(lines + [f"{a} " + " ".join(f"{by[a, b]:>4g}" for b in symbols) for a in symbols]) + "\n"


def rate_matrix(text: str, kinds: int = 20) -> tuple[list[tuple[int, int, float]], list[float]]:
    """Lower triangle of exchangeabilities, then frequencies: (i, j, value) in both directions, and the frequencies. What follows these is a remark."""
    need = kinds * (kinds - 1) // 2
    fields = text.split()[: need + kinds]
    if len(fields) < need + kinds:
        raise ValueError(f"{len(fields)} numbers; {need + kinds} are needed")
    numbers = [float(x) for x in fields]  # anything else among them is an error
    cells, at = [], iter(numbers)
    for i in range(1, kinds):
        for j in range(i):
            v = next(at)
            cells += [(i, j, v), (j, i, v)]
    return cells, [next(at) for _ in range(kinds)]


def genetic_code(amino: str, starts: str = "", bases: str = "TCAG") -> dict[str, tuple[str, bool]]:
    """codon -> (residue, may begin) of a 64-letter line of residues and one of start marks, bases in the given order."""
    if len(amino) != 64 or (starts and len(starts) != 64):
        raise ValueError("64 letters are needed")
    codons = [a + b + c for a in bases for b in bases for c in bases]
    return {c: (amino[k], bool(starts) and starts[k] == "M") for k, c in enumerate(codons)}


def mask_columns(text: str) -> list[tuple[int, bool]]:
    """(col, keep) of a mask of 0 and 1; comment lines are dropped."""
    mask = "".join(line.strip() for line in text.splitlines() if not line.lstrip().startswith("#"))
    if set(mask) - {"0", "1"}:
        raise ValueError("a mask holds 0 and 1 only")
    return [(i + 1, c == "1") for i, c in enumerate(mask)]


def mixture(text: str) -> list[tuple[float, list[float]]]:
    """Components of a mixture file: `K Q`, then a weight and K parameters for each of Q components."""
    numbers = [float(x) for line in text.splitlines() for x in line.split("#")[0].split()]
    if len(numbers) < 2:
        raise ValueError("no sizes")
    k, q = int(numbers[0]), int(numbers[1])
    if len(numbers) != 2 + q * (k + 1):
        raise ValueError(f"{q} components of {k} parameters need {q * (k + 1)} numbers")
    return [(numbers[p], numbers[p + 1 : p + 1 + k]) for p in range(2, len(numbers), k + 1)]


def _field(i: int, kind: str) -> Column:
    return F.try_element_at("fields", F.lit(i)).try_cast(kind)


def tabular_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a tab report of twelve columns (query, target, identity, length, mismatches, gaps, ranges, E-value, score)."""
    names = "query target pct_id length mismatches gap_opens qstart qend tstart tend evalue score".split()
    kinds = "string string double int int int int int int int double double".split()
    return read_columns(spark, path).where(F.size("fields") >= 12).select(*[_field(i + 1, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])
