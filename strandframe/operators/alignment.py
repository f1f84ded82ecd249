"""Operators on alignments: rows of equal length with gaps, grouped by an alignment id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = "-"


def residue_table(rows: DataFrame, aln: str, key: str, aseq: Column) -> DataFrame:
    """Long form (aln, key, col, res): 1-based columns, gaps included."""
    return rows.select(F.col(aln).alias("aln"), F.col(key).alias("key"), F.posexplode(F.split(aseq, "")).alias("col", "res")).where("res <> ''").withColumn("col", F.col("col") + 1)


def column_counts(res: DataFrame) -> DataFrame:
    """n of each residue in each column, without gaps."""
    return res.where(F.col("res") != GAP).groupBy("aln", "col", "res").agg(F.count("*").alias("n"))


_DNA_SETS = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}
_AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: Each alphabet's symbols, and the symbols that each degenerate code stands for.
ALPHABETS = {
    "dna": ("ACGT", _DNA_SETS | {"U": "T", "X": "ACGT"}),
    "rna": ("ACGU", {k: v.replace("T", "U") for k, v in _DNA_SETS.items()} | {"T": "U", "X": "ACGU"}),
    "amino": (_AMINO, {"B": "DN", "J": "IL", "Z": "EQ", "O": "K", "U": "C", "X": _AMINO}),
}


def alphabet_shares(alphabet: str) -> list[tuple[str, str, float]]:
    """(code, symbol, share): a degenerate code is spread evenly over the symbols that it stands for."""
    symbols, sets = ALPHABETS[alphabet]
    return [(c, c, 1.0) for c in symbols] + [(c, s, 1 / len(of)) for c, of in sets.items() for s in of]


def spread_counts(res: DataFrame, alphabet: str, *, weights: DataFrame | None = None) -> DataFrame:
    """aln, col, res, n: residues by column, degenerate codes spread over their symbols and rows weighted by `weights(aln, key, weight)` (a missing row weighs 1).

    Codes of either case count; gaps and what the alphabet does not know are left out.
    """
    rows = res.withColumn("code", F.upper("res"))
    if weights is not None:
        rows = rows.join(weights.select("aln", "key", "weight"), ["aln", "key"], "left")
    # summed by code first, so that only codes by column meet the table
    sums = rows.groupBy("aln", "col", "code").agg((F.count("*") if weights is None else F.sum(F.coalesce("weight", F.lit(1.0)))).cast("double").alias("_n"))
    table = res.sparkSession.createDataFrame(alphabet_shares(alphabet), "code string, symbol string, share double")
    return sums.join(F.broadcast(table), "code").groupBy("aln", "col", F.col("symbol").alias("res")).agg(F.sum(F.col("_n") * F.col("share")).alias("n"))


def summary(rows: DataFrame, aln: str, key: str, aseq: Column, *, most_pairs: int | None = 1000, seed: int = 42) -> DataFrame:
    """aln, nseq, alen, nres, small, large, avlen and pid of each alignment.

    pid is the mean identity of all pairs, or, where there are more than `most_pairs`, of as many
    pairs drawn with replacement by seeded hashes; null for one row.
    """
    from strandframe.operators.pairwise import pair_table

    part = rows.select(F.col(aln).alias("aln"), F.col(key).alias("key"), aseq.alias("_s")).where("_s IS NOT NULL")
    n = F.length(F.translate("_s", GAP, ""))
    sums = part.groupBy("aln").agg(F.count("*").alias("nseq"), F.max(F.length("_s")).alias("alen"), F.sum(n).alias("nres"), F.min(n).alias("small"), F.max(n).alias("large"), F.avg(n).alias("avlen"))
    if most_pairs is None:
        return sums.join(pair_table(part, "aln", "key", F.col("_s")).groupBy("aln").agg(F.avg("pid").alias("pid")), "aln", "left")
    many = F.col("nseq") * (F.col("nseq") - 1) / 2 > most_pairs
    sizes = sums.select("aln", "nseq", many.alias("many"))
    few = pair_table(part.join(sizes.where("NOT many"), "aln"), "aln", "key", F.col("_s")).groupBy("aln").agg(F.avg("pid").alias("pid"))
    numbered = part.withColumn("_k", F.row_number().over(Window.partitionBy("aln").orderBy(F.xxhash64(F.lit(seed), "key"), "key")) - 1)
    drawn = sizes.where("many").select("aln", "nseq", F.explode(F.sequence(F.lit(1), F.lit(most_pairs))).alias("_d"))
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("first"), "_d"), F.col("nseq"))
    drawn = drawn.withColumn("_i", first).withColumn("_j", F.pmod(F.col("_i") + 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit("second"), "_d"), F.col("nseq") - 1), F.col("nseq")))
    one = numbered.select("aln", F.col("_k").cast("long").alias("_i"), F.split("_s", "").alias("_a"), n.alias("_m"))
    two = numbered.select("aln", F.col("_k").cast("long").alias("_j"), F.split("_s", "").alias("_b"), n.alias("_n"))
    met = drawn.join(one, ["aln", "_i"]).join(two, ["aln", "_j"])
    same = F.size(F.filter(F.arrays_zip("_a", "_b"), lambda x: (x["_a"] == x["_b"]) & (x["_a"] != GAP)))
    shorter = F.least("_m", "_n")
    sampled = met.groupBy("aln").agg(F.avg(F.when(shorter > 0, same / shorter).otherwise(0.0)).alias("pid"))
    return sums.join(few.unionByName(sampled), "aln", "left")


def differing(one: DataFrame, two: DataFrame, aln: str, key: str, aseq: str) -> DataFrame:
    """Rows (aln, key) that stand in one alignment only, or with different residues, whatever their case or gap symbol: none if the alignments are the same."""
    plain = lambda df, name: df.select(F.col(aln).alias("aln"), F.col(key).alias("key"), F.translate(F.upper(aseq), "._~", "---").alias(name))
    both = plain(one, "_x").withColumn("_in_one", F.lit(True)).join(plain(two, "_y").withColumn("_in_two", F.lit(True)), ["aln", "key"], "full")
    return both.where("_in_one IS NULL OR _in_two IS NULL OR NOT _x <=> _y").select("aln", "key")


def repeated_names(rows: DataFrame, aln: str, name: str) -> DataFrame:
    """(aln, name, n) of names that stand on several rows of one alignment."""
    return rows.groupBy(F.col(aln).alias("aln"), F.col(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def columns_between(res: DataFrame, first: int, last: int, *, places: DataFrame | None = None) -> DataFrame:
    """The residues of columns first..last (1-based), renumbered from 1; with `places(aln, col, place, keep)` the bounds are places of the reference line, and columns between them stay."""
    if not 1 <= first <= last:
        raise ValueError("1 <= first <= last is needed")
    if places is None:
        return res.where(F.col("col").between(first, last)).withColumn("col", F.col("col") - (first - 1))
    at = places.where("keep").groupBy("aln").agg(F.min(F.when(F.col("place") == first, F.col("col"))).alias("_lo"), F.max(F.when(F.col("place") == last, F.col("col"))).alias("_hi"))
    return res.join(at, "aln").where("col BETWEEN _lo AND _hi").withColumn("col", F.col("col") - F.col("_lo") + 1).drop("_lo", "_hi")


def column_information(res: DataFrame, kinds: int = 26) -> DataFrame:
    """The number of residues, and log2(kinds) less the column's entropy over them; a column of gaps only has none and tells nothing."""
    counts = res.groupBy("aln", "col", "res").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("res") != GAP, F.col("n")))
    sums = counts.groupBy("aln", "col").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_res"), F.sum(F.col("n") * F.log2("n")).alias("_x"))
    information = F.log2(F.lit(float(kinds))) - F.log2("n_res") + F.col("_x") / F.col("n_res")
    return sums.select("aln", "col", "n_res", F.when(F.col("n_res") > 0, information).otherwise(0.0).alias("information"))


def occupancy(res: DataFrame, gap_threshold: float = 0.5) -> DataFrame:
    """occupied (share of rows with a residue) and keep (share of gaps <= gap_threshold) of each column."""
    gap = (F.col("res") == GAP).cast("long")
    return res.groupBy("aln", "col").agg((1 - F.sum(gap) / F.count("*")).alias("occupied"), (F.sum(gap) / F.count("*") <= gap_threshold).alias("keep"))


def consensus_line(res: DataFrame, symfrac: float = 0.5) -> DataFrame:
    """The most frequent residue (ties: first letter) of columns with at least `symfrac` residues, else a gap, as one line per alignment."""
    per = res.groupBy("aln", "col", "res").agg(F.count("*").alias("n"))
    best = per.groupBy("aln", "col").agg(F.sum("n").alias("tot"), F.sum(F.when(F.col("res") != GAP, F.col("n")).otherwise(0)).alias("nres"), F.min(F.when(F.col("res") != GAP, F.struct((-F.col("n")).alias("m"), "res"))).alias("best"))
    sym = F.when(F.col("nres") / F.col("tot") >= symfrac, F.col("best.res")).otherwise(GAP)
    return best.groupBy("aln").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", sym.alias("s")))), lambda x: x["s"]), "").alias("consensus"))


def fragments(rows: DataFrame, aln: str, key: str, aseq: Column, threshold: float = 0.5) -> DataFrame:
    """is_fragment: the span from the first to the last residue is shorter than ceil(threshold x length). Rows without residues span 0."""
    s = rows.select(F.col(aln).alias("aln"), F.col(key).alias("key"), aseq.alias("_a"))
    inner = F.length(F.regexp_replace(F.regexp_replace("_a", f"^{GAP}+", ""), f"{GAP}+$", ""))
    return s.select("aln", "key", inner.cast("long").alias("span"), (inner < F.ceil(F.length("_a") * threshold)).alias("is_fragment"))


def position_weights(res: DataFrame) -> DataFrame:
    """Position-based weights that sum to the number of rows: each residue gives 1 / (kinds x copies) of its column, divided by the row's residues. Rows without residues weigh 0 unless all do."""
    # counts per (column, residue) are small; each residue of the long table then looks its share up
    counts = column_counts(res)
    share = counts.withColumn("share", 1 / (F.count("*").over(Window.partitionBy("aln", "col")) * F.col("n"))).select("aln", "col", "res", "share")
    raw = res.join(share, ["aln", "col", "res"], "left").groupBy("aln", "key").agg((F.coalesce(F.sum("share"), F.lit(0.0)) / F.greatest(F.count("share"), F.lit(1))).alias("raw"))
    totals = raw.groupBy("aln").agg(F.sum("raw").alias("_sum"), F.count("*").alias("_n"))
    return raw.join(totals, "aln").select("aln", "key", F.when(F.col("_sum") > 0, F.col("raw") * F.col("_n") / F.col("_sum")).otherwise(1.0).alias("weight"))


#: Groups of amino acids that replace each other often, and those that do so at times.
STRONG_GROUPS = ("STA", "NEQK", "NHQK", "NDEQ", "QHRK", "MILV", "MILF", "HY", "FYW")
WEAK_GROUPS = ("CSA", "ATV", "SAG", "STNK", "STPA", "SGND", "SNDEQK", "NDEQHK", "NEQHRK", "FVLIM", "HFY")
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def conservation(res: DataFrame, *, letters: str = AMINO, strong: Sequence[str] = STRONG_GROUPS, weak: Sequence[str] = WEAK_GROUPS) -> DataFrame:
    """(aln, col, mark): * for columns of one letter, : for those within a strong group, . within a weak one, else a space. A column with a gap or another symbol has a space."""
    found = res.groupBy("aln", "col").agg(F.sort_array(F.collect_set(F.upper("res"))).alias("_s"))
    within = lambda group: F.size(F.array_except("_s", F.array(*[F.lit(c) for c in group]))) == 0
    any_of = lambda groups: reduce(Column.__or__, map(within, groups), F.lit(False))
    mark = F.when(~within(letters), " ").when(F.size("_s") == 1, "*").when(any_of(strong), ":").when(any_of(weak), ".").otherwise(" ")
    return found.select("aln", "col", mark.alias("mark"))
