"""Operators that follow a reference line or posterior marks along an alignment.

`res` is the long table (aln, key, col, res) without holes; `places` is (aln, col, held, place): whether a
column is one of the reference, and the number of reference columns up to it. `places` has one row per
column, so its windows stay small however many rows an alignment has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.operators.editing import reference_places

GAPS = ("-", ".", "_", "~")
#: Rows of an alignment are dealt over so many tiles where each query meets all of them.
TILES = 64


def _is_residue(c: Column) -> Column:
    return ~c.isin(*GAPS)


def numbered_places(mask: DataFrame) -> DataFrame:
    """`places` of a column mask (aln, col, keep)."""
    place = F.sum(F.col("keep").cast("int")).over(Window.partitionBy("aln").orderBy("col"))
    return mask.select("aln", "col", F.col("keep").alias("held"), place.cast("int").alias("place"))


def _insertions(res: DataFrame, places: DataFrame) -> DataFrame:
    return res.where(_is_residue(F.col("res"))).join(places.where("NOT held"), ["aln", "col"]).groupBy("aln", "place", "key").agg(F.count("*").alias("n"))


def insert_stats(res: DataFrame, places: DataFrame) -> DataFrame:
    """n_rows with an insertion after each reference place, their share of all rows and their mean length. Places without one are left out."""
    rows = res.where("col = 1").groupBy("aln").agg(F.count("*").alias("_all"))
    met = _insertions(res, places).groupBy("aln", "place").agg(F.count("*").alias("n_rows"), F.avg("n").alias("mean_length"))
    return met.join(rows, "aln").select("aln", "place", "n_rows", (F.col("n_rows") / F.col("_all")).alias("share"), "mean_length")


def by_insert(res: DataFrame, places: DataFrame, place: int, least: int, most: int | None = None) -> DataFrame:
    """(aln, key) of rows whose insertion after `place` has a length within the bounds, least >= 1."""
    found = _insertions(res, places).where((F.col("place") == place) & (F.col("n") >= least))
    return (found if most is None else found.where(F.col("n") <= most)).select("aln", "key")


def by_reference_length(res: DataFrame, places: DataFrame, *, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """(aln, key, n) of rows with residues in at least and at most these shares of the reference columns; n counts them. An alignment without a reference column has no row."""
    held = res.join(places.where("held"), ["aln", "col"]).groupBy("aln", "key").agg(F.count_if(_is_residue(F.col("res"))).alias("n"), F.count("*").alias("_all"))
    return held.where((F.col("n") >= least * F.col("_all")) & (F.col("n") <= most * F.col("_all"))).select("aln", "key", "n")


def shared_inserts(res: DataFrame, places: DataFrame, queries: DataFrame, *, tiles: int = TILES) -> DataFrame:
    """(aln, a, b, n_shared, n_inserts, share): for each row a of `queries(aln, key)` and each other row b of its alignment, the gaps between reference columns in which either has an insertion, and those in which the insertions of both begin in the same column. Without any insertion the share is 1.

    The result has a row for each pair, so no pair is shuffled: the rows are dealt over `tiles`, those of a tile
    with the same insertions stand together, and a query, copied to each tile, is compared with each such group once.
    """
    at = res.join(places.select("aln", "col", "held", "place"), ["aln", "col"], "left").where("aln IS NOT NULL AND key IS NOT NULL")
    inside = F.when(_is_residue(F.col("res")) & ~F.col("held"), F.col("col"))
    gaps = at.groupBy("aln", "key", "place").agg(F.min(inside).alias("_at"), F.bool_or(F.col("col") == 1).alias("_row"))
    begins = F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct(F.col("place").alias("p"), F.col("_at").alias("i")))))
    rows = gaps.groupBy("aln", "key").agg(begins.alias("_b"), F.bool_or("_row").alias("_row")).where("_row").drop("_row")
    wanted = queries.select("aln", "key").distinct().withColumn("_q", F.lit(True))
    return _compared(rows.join(wanted.hint("merge"), ["aln", "key"], "left"), tiles)


def _compared(rows: DataFrame, tiles: int) -> DataFrame:
    """The pairs of `shared_inserts` of rows (aln, key, _b, _q): the insertions as structs of place and first column, and whether the row is a query."""
    n = max(tiles, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tile = F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")
    groups = rows.groupBy("aln", tile.alias("_t"), F.col("_b").alias("_y")).agg(F.collect_list("key").alias("_keys")).repartition(n, "aln", "_t")
    asked = rows.where("_q").select("aln", F.col("key").alias("a"), F.col("_b").alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_t")).repartition(n, "aln", "_t")
    met = asked.join(groups.hint("merge"), ["aln", "_t"])
    both = F.size(F.array_intersect(F.transform("_x", lambda v: v["p"]), F.transform("_y", lambda v: v["p"])))
    same, either = F.size(F.array_intersect("_x", "_y")).cast("long"), (F.size("_x") + F.size("_y") - both).cast("long")
    counted = met.select("aln", "a", same.alias("n_shared"), either.alias("n_inserts"), "_keys").withColumn("share", F.when(F.col("n_inserts") == 0, 1.0).otherwise(F.col("n_shared") / F.col("n_inserts")))
    return counted.select("aln", "a", F.explode("_keys").alias("b"), "n_shared", "n_inserts", "share").where("a <> b")


def flush_left(res: DataFrame, places: DataFrame) -> DataFrame:
    """The long table with the residues of each insertion moved to its left end; the reference columns stay."""
    joined = res.join(places, ["aln", "col"])
    block = Window.partitionBy("aln", "key", "place")
    rank = F.row_number().over(block.orderBy((~_is_residue(F.col("res"))).cast("int"), "col"))
    moved = joined.where("NOT held").withColumn("_to", (F.min("col").over(block) + rank - 1).cast("int"))
    return joined.where("held").select("aln", "key", "col", "res").unionByName(moved.select("aln", "key", F.col("_to").alias("col"), "res"))


def coverage(res: DataFrame, places: DataFrame) -> DataFrame:
    """For each reference place: n_residues, n_gaps, n_spanning (rows whose first and last reference residues enclose it) and n_internal (gaps of such rows)."""
    at = res.join(places.where("held"), ["aln", "col"]).withColumn("_has", _is_residue(F.col("res")))
    held = at.groupBy("aln", "place").agg(F.count_if("_has").alias("n_residues"), F.count_if(~F.col("_has")).alias("n_gaps"))
    ends = at.where("_has").groupBy("aln", "key").agg(F.min("place").alias("lo"), (F.max("place") + 1).alias("hi"))
    turns = ends.select("aln", F.explode(F.array(F.struct(F.col("lo").alias("place"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("place"), F.lit(-1).alias("d")))).alias("_t"))
    steps = turns.groupBy("aln", F.col("_t.place").alias("place")).agg(F.sum("_t.d").alias("_d"))
    running = F.sum(F.coalesce("_d", F.lit(0))).over(Window.partitionBy("aln").orderBy("place"))
    all_places = held.join(steps, ["aln", "place"], "left").withColumn("n_spanning", running)
    return all_places.select("aln", "place", "n_residues", "n_gaps", "n_spanning", (F.col("n_spanning") - F.col("n_residues")).alias("n_internal"))


def posterior_middle(mark: Column) -> Column:
    """The middle of the range that a mark 0 to 9 or * stands for; null for a gap."""
    return F.when(mark == "0", 0.025).when(mark == "*", 0.975).when(mark.rlike("^[1-9]$"), mark.try_cast("double") / 10)


def posterior_least(mark: Column) -> Column:
    """The least probability that a mark stands for; null for a gap."""
    return F.when(mark == "0", 0.0).when(mark == "*", 0.95).when(mark.rlike("^[1-9]$"), mark.try_cast("double") / 10 - 0.05)


def posterior_stats(marks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each mark (n_0 to n_9, n_star), n_gaps, n_marks and the mean probability; `marks` is (aln, key, col, pp), `by` a column or row of it."""
    p = posterior_middle(F.col("pp"))
    counts = [F.count_if(F.col("pp") == m).alias(f"n_{'star' if m == '*' else m}") for m in "0123456789*"]
    return marks.groupBy(*by).agg(*counts, F.count_if(F.col("pp").isin(*GAPS)).alias("n_gaps"), F.count(p).alias("n_marks"), F.avg(p).alias("mean_pp"))


def posterior_mask(marks: DataFrame, *, least: float = 0.95, share: float | None = 0.95) -> DataFrame:
    """(aln, col, keep): at least `share` of a column's marks stand for `least` or more; with share=None their mean does. Columns without marks are dropped."""
    low = posterior_least(F.col("pp"))
    enough = F.avg(posterior_middle(F.col("pp"))) >= least if share is None else F.count_if(low >= least - 1e-9) >= share * F.count(low)
    return marks.groupBy("aln", "col").agg((F.coalesce(enough, F.lit(False)) & (F.count(low) > 0)).alias("keep"))


def masked_by_posterior(aseq: Column, marks: Column, least: float) -> Column:
    """The row with a gap at each residue whose mark stands for less than `least`."""
    return F.array_join(F.zip_with(F.split(aseq, ""), F.split(marks, ""), lambda c, m: F.when(posterior_least(m) < least - 1e-9, "-").otherwise(c)), "")


def trimmed(aseq: Column, part: Column) -> Column:
    """The row with gaps for all residues outside the first place where `part` occurs in the ungapped row; null if it does not."""
    start = F.instr(F.regexp_replace(aseq, "[-._~]", ""), part)
    letters = F.filter(F.split(aseq, ""), lambda c: c != "")
    kept = F.zip_with(letters, reference_places(aseq), lambda c, n: F.when((n <= 0) | n.between(start, start + F.length(part) - 1), c).otherwise("-"))
    return F.when(start > 0, F.array_join(kept, ""))
