"""Operators on pairs of rows of one alignment. All pairs are their result, so they are for alignments, not for corpora."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "-"


#: Rows of an alignment are dealt over so many tiles, and each pair of tiles is a task of its own.
TILES = 8


def pair_table(rows: DataFrame, aln: str, key: str, aseq: Column, *, tiles: int = TILES) -> DataFrame:
    """(aln, i, j) with i < j: n_id, n_match (both residues), n_any, len_i, len_j, pid (by the shorter length), pmatch.

    A row meets the rows of its own and of each other tile, so one alignment's pairs are spread over
    tiles (tiles + 1) / 2 keys, and a row is copied `tiles` times.
    """
    tile = F.pmod(F.xxhash64(F.col(key)), F.lit(tiles)).cast("int")
    side = rows.select(F.col(aln).alias("aln"), F.col(key).alias("k"), F.split(aseq, "").alias("s"), F.length(F.translate(aseq, GAP, "")).alias("n"), tile.alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_u"))
    side = side.withColumns({"_p": F.least("_t", "_u"), "_q": F.greatest("_t", "_u")})
    a = side.select("aln", "_p", "_q", F.col("k").alias("i"), F.col("s").alias("_a"), F.col("n").alias("len_i"), F.col("_t").alias("_ta"))
    b = side.select("aln", "_p", "_q", F.col("k").alias("j"), F.col("s").alias("_b"), F.col("n").alias("len_j"), F.col("_t").alias("_tb"))
    both = a.join(b, ["aln", "_p", "_q"]).where("i < j AND (_p = _q OR _ta <> _tb)")
    z = F.expr("arrays_zip(_a, _b)")
    count = lambda f: F.size(F.filter(z, f)).cast("long")
    gap = lambda c: c == GAP
    out = both.select(
        "aln", "i", "j", "len_i", "len_j",
        count(lambda x: (x["_a"] == x["_b"]) & ~gap(x["_a"])).alias("n_id"),
        count(lambda x: ~gap(x["_a"]) & ~gap(x["_b"])).alias("n_match"),
        count(lambda x: ~gap(x["_a"]) | ~gap(x["_b"])).alias("n_any"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.withColumn("pid", ratio(F.col("n_id"), F.least("len_i", "len_j"))).withColumn("pmatch", ratio(F.col("n_match"), F.col("n_any")))


def averages(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n_pairs, mean pid, mean pmatch and connectivity (share of pairs with pid > threshold) of each alignment."""
    return pairs.groupBy("aln").agg(F.count("*").alias("n_pairs"), F.avg("pid").alias("mean_pid"), F.avg("pmatch").alias("mean_pmatch"), F.avg((F.col("pid") > threshold).cast("double")).alias("connectivity"))


def jukes_cantor(pairs: DataFrame, kinds: int = 4) -> DataFrame:
    """Distance -(K-1)/K ln(1 - D K/(K-1)) with D the differing share of columns with both residues; null where it has no value."""
    d = 1 - F.col("n_id") / F.col("n_match")
    x = 1 - d * kinds / (kinds - 1)
    return pairs.select("aln", "i", "j", F.when((F.col("n_match") > 0) & (x > 1e-12), F.abs(-(kinds - 1) / kinds * F.log(x))).alias("distance"))


def difference_matrix(pairs: DataFrame, rows: DataFrame, aln: str, key: str) -> DataFrame:
    """Long form of the symmetric matrix 1 - pid, diagonal included."""
    d = pairs.select("aln", "i", "j", (1 - F.col("pid")).alias("d"))
    diagonal = rows.select(F.col(aln).alias("aln"), F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("d"))
    return d.unionByName(d.select("aln", F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(diagonal)


def identity_clusters(pairs: DataFrame, rows: DataFrame, aln: str, key: str, threshold: float = 0.5) -> DataFrame:
    """Single linkage at pid >= threshold: aln, key, cluster (the least key). Labels move to the least neighbour until none changes."""
    links = pairs.where(F.col("pid") >= threshold).select("aln", "i", "j")
    arcs = links.unionByName(links.select("aln", F.col("j").alias("i"), F.col("i").alias("j"))).cache()
    label = rows.select(F.col(aln).alias("aln"), F.col(key).alias("key"), F.col(key).alias("cluster")).cache()
    while True:
        near = arcs.join(label, (arcs["aln"] == label["aln"]) & (arcs["j"] == label["key"])).groupBy(arcs["aln"], "i").agg(F.min("cluster").alias("m")).select(F.col("aln").alias("_aln"), F.col("i").alias("_i"), "m")
        new = label.join(near, (F.col("aln") == F.col("_aln")) & (F.col("key") == F.col("_i")), "left").select("aln", "key", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"), (F.col("m") < F.col("cluster")).alias("moved"))
        new = _cut(new)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        label = new.drop("moved")


def _cut(df: DataFrame) -> DataFrame:
    from strandframe.functions.storage import checkpoint

    return checkpoint(df)


def cluster_weights(clusters: DataFrame) -> DataFrame:
    """1 / cluster size, scaled to sum to the number of rows."""
    sizes = clusters.groupBy("aln", "cluster").agg(F.count("*").alias("_n"))
    totals = sizes.groupBy("aln").agg(F.count("*").alias("_c"), F.sum("_n").alias("_all"))
    return clusters.join(sizes, ["aln", "cluster"]).join(totals, "aln").select("aln", "key", (F.col("_all") / F.col("_c") / F.col("_n")).alias("weight"))


def identity_filter(rows: DataFrame, aln: str, key: str, aseq: Column, threshold: float = 0.5, *, prefer: str = "order", symfrac: float = 0.5) -> DataFrame:
    """Greedy: a row stays if its identity to every row that stayed is below the threshold. Sequential by definition, within one alignment.

    Rows are taken in key order, or with prefer="span" those first whose span from the first to the
    last residue covers the most consensus columns (at least `symfrac` residues); ties by key.
    """
    import numpy as np
    import pandas as pd

    if prefer not in ("order", "span"):
        raise ValueError(f"unknown preference {prefer}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        codes = np.array([np.frombuffer(s.encode("utf-32-le"), dtype="<u4") for s in pdf["s"]])
        held = codes != ord(GAP)
        lengths, order = held.sum(axis=1), np.arange(len(codes))
        if prefer == "span":
            consensus = np.concatenate([[0], np.cumsum(held.mean(axis=0) >= symfrac)])
            last = codes.shape[1] - held[:, ::-1].argmax(axis=1)
            cover = np.where(lengths > 0, consensus[last] - consensus[held.argmax(axis=1)], 0)
            order = np.argsort(-cover, kind="stable")
        kept: list[int] = []
        for k in order:
            shorter = np.minimum(lengths[k], lengths[kept])
            same = ((codes[kept] == codes[k]) & held[k]).sum(axis=1)
            if not len(kept) or np.all(np.where(shorter > 0, same < threshold * shorter, threshold > 0)):
                kept.append(int(k))
        return pd.DataFrame({"aln": [pdf["aln"].iloc[0]] * len(kept), "key": pdf["key"].to_numpy()[kept]})

    part = rows.select(F.col(aln).alias("aln"), F.col(key).alias("key"), aseq.alias("s"))
    return part.groupBy("aln").applyInPandas(run, f"aln {part.schema['aln'].dataType.simpleString()}, key {part.schema['key'].dataType.simpleString()}")


def expected_distance_limit(kinds: int = 4) -> float:
    """The differing share at which the distance has no value."""
    return math.nextafter((kinds - 1) / kinds, 0)
