"""Filters and edits of alignments: rows by length, ambiguity or truncation, columns by mask, and sets of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = "-"


def ungapped(aseq: Column, gaps: str = "-._~") -> Column:
    return F.translate(aseq, gaps, "")


def by_length(df: DataFrame, seq: str, *, least: int | None = None, most: int | None = None) -> DataFrame:
    n = F.length(ungapped(F.col(seq)))
    out = df if least is None else df.where(n >= least)
    return out if most is None else out.where(n <= most)


def by_median_length(df: DataFrame, seq: str, by: str, *, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose length is within the fractions of their group's upper median. Lengths are counted first, so a group is as many rows as it has lengths."""
    n = F.length(ungapped(F.col(seq)))
    counts = df.groupBy(F.col(by).alias("_by"), n.alias("_n")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_by")
    run = counts.withColumn("_cum", F.sum("_c").over(w.orderBy("_n"))).withColumn("_half", F.floor(F.sum("_c").over(w) / 2))
    median = run.where("_cum > _half").groupBy("_by").agg(F.min("_n").alias("_median"))
    joined = df.join(median, F.col(by).eqNullSafe(F.col("_by")))
    for share, keep in ((low, lambda x: n >= x), (high, lambda x: n <= x)):
        if share is not None:
            joined = joined.where(keep(F.floor(F.col("_median") * share)))
    return joined.drop("_by", "_median")


def by_ambiguity(df: DataFrame, seq: str, *, most: int, plain: str = "ACGTU") -> DataFrame:
    """Rows with at most `most` letters outside `plain`."""
    return df.where(F.length(F.regexp_replace(F.upper(F.regexp_replace(seq, "[^A-Za-z]", "")), f"[{plain}]", "")) <= most)


def truncated(df: DataFrame, aseq: str, least: int) -> Column:
    """Whether a row begins or ends with `least` or more gaps."""
    return F.col(aseq).rlike(f"^[-.~_]{{{least}}}|[-.~_]{{{least}}}$")


def by_names(df: DataFrame, names: DataFrame, column: str, *, keep: bool = True) -> DataFrame:
    """Rows whose name is listed, or with keep=False those whose is not."""
    listed = names.select(F.col(names.columns[0]).alias(column)).distinct()
    return df.join(listed, column, "left_semi" if keep else "left_anti")


def missing_names(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return names.select(F.col(names.columns[0]).alias(column)).distinct().join(df, column, "left_anti")


def reordered(df: DataFrame, order: DataFrame, column: str, *, rest: bool = False) -> DataFrame:
    """Rows that `order(name, place)` lists, with `place`, by which the caller sorts or numbers them; a name listed twice has its least place. With `rest` the others stay, too, with a null place."""
    name, place = order.columns[:2]
    listed = order.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(column)).agg(F.min(place).alias("place"))
    return df.join(listed, column, "left" if rest else "inner")


def by_columns(res: DataFrame, mask: DataFrame) -> DataFrame:
    """The long table without the columns that `mask(aln, col, keep)` drops, columns numbered anew. A mask has one row per column, so its window is small."""
    place = F.sum(F.col("keep").cast("int")).over(Window.partitionBy("aln").orderBy("col"))
    kept = mask.withColumn("_new", place).where("keep").select("aln", "col", "_new")
    return res.join(kept, ["aln", "col"]).select("aln", "key", F.col("_new").cast("int").alias("col"), "res")


def rows_from_residues(res: DataFrame) -> DataFrame:
    """(aln, key, aseq) of a long table without holes."""
    ordered = F.sort_array(F.collect_list(F.struct("col", "res")))
    return res.groupBy("aln", "key").agg(F.array_join(F.transform(ordered, lambda x: x["res"]), "").alias("aseq"))


def gap_mask(res: DataFrame, *, drop: str = "all") -> DataFrame:
    """(aln, col, keep): drops columns that are all gaps, or with drop='any' those that hold one."""
    gaps = F.col("res").isin("-", ".", "_", "~")
    test = F.bool_and(gaps) if drop == "all" else F.bool_or(gaps)
    return res.groupBy("aln", "col").agg((~test).alias("keep"))


def merged_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("aln", "col", F.col("keep").alias("_a")).join(b.select("aln", "col", F.col("keep").alias("_b")), ["aln", "col"]).select("aln", "col", (F.col("_a") & F.col("_b")).alias("keep"))


def reference_places(reference: Column) -> Column:
    """For each column its number among the reference's residues, or minus the number before it for an insertion."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        held = ~c.isin("-", ".", "_", "~")
        n = acc["n"] + held.cast("int")
        return F.struct(n.alias("n"), F.array_append(acc["out"], F.when(held, n).otherwise(-n)).alias("out"))

    return F.aggregate(F.filter(F.split(reference, ""), lambda c: c != ""), start, step, lambda acc: acc["out"])


def merged(rows: DataFrame, *, aln: str = "aln", key: str = "key", aseq: str = "aseq", reference: str = "reference") -> DataFrame:
    """(aln, key, aseq) of all alignments on one reference: insertions are padded to the widest of any alignment.

    The widths are one row per reference column; each row is then laid out on its own, so alignments
    of any number of rows are never gathered. The references must have the same residues.
    """
    spaces = F.regexp_extract_all(F.concat(F.col(reference), F.lit("$")), F.lit(r"([-._~]*)([^-._~])"), 1)
    widths = rows.select(reference).distinct().select(F.posexplode(F.transform(spaces, F.length)).alias("k", "w")).groupBy("k").agg(F.max("w").alias("w"))
    wide = widths.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("_wide"))
    inserts = F.transform(spaces, F.length)
    at = F.aggregate(inserts, F.array(F.lit(1)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n + 1))
    laid = rows.crossJoin(F.broadcast(wide)).withColumn("_ins", inserts).withColumn("_at", at)  # one row: the widths
    part = F.transform("_ins", lambda n, k: F.concat(F.rpad(F.substr(F.col(aseq), F.get("_at", k), n), F.get("_wide", k), "."), F.substr(F.col(aseq), F.get("_at", k) + n, F.lit(1))))
    return laid.select(F.col(aln).alias("aln"), F.col(key).alias("key"), F.array_join(part, "").alias("aseq"))


def accuracy(known: DataFrame, test: DataFrame) -> DataFrame:
    """Share of residues at the same reference place: `known` and `test` are (key, aseq, reference) with the same ungapped rows.

    The rows are joined whole, by a shuffle, and their residues compared side by side.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        z = F.arrays_zip(F.split("aseq", "").alias("c"), reference_places(F.col("reference")).alias("p"))
        held = F.filter(z, lambda x: ~x["c"].isin("-", ".", "_", "~", ""))
        return df.select("key", F.transform(held, lambda x: x["p"]).alias(name))

    both = placed(known, "p").join(placed(test, "q").hint("merge"), "key").withColumn("n", F.least(F.size("p"), F.size("q"))).where("n > 0")
    right = F.size(F.filter(F.arrays_zip("p", "q"), lambda x: x["p"] == x["q"]))
    return both.groupBy("key").agg(F.sum("n").alias("n"), F.sum(right).alias("right")).withColumn("accuracy", F.col("right") / F.col("n"))


def fetch_ranges(requests: DataFrame, table: DataFrame, *, source: str, seq: str) -> DataFrame:
    """(newname, subseq) of requests (newname, start, end, source): 1-based ends included, end 0 is the last residue, start > end is the other strand."""
    from strandframe.functions.symbols import reverse_complement

    met = requests.join(table.select(F.col(source).alias("source"), F.col(seq).alias("_s")), "source")
    end = F.when(F.col("end") == 0, F.length("_s")).otherwise(F.col("end"))
    part = F.substr(F.col("_s"), F.least("start", end).cast("int"), (F.abs(end - F.col("start")) + 1).cast("int"))
    return met.select("newname", F.when(F.col("start") > end, reverse_complement(part)).otherwise(part).alias("subseq"))
