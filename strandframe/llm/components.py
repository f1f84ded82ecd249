"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import checkpoint


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node that can be reached) for each node of `edges(a long, b long)`.

    Both steps take a minimum per node, which combines before the shuffle, and an equi-join, whose
    hot nodes can be split; no neighbour list is ever gathered. Each round is written to the
    checkpoint folder, so a lost executor costs one round at most. Loops and repeated edges are
    harmless; an empty table gives an empty result.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    both = checkpoint(both)
    before = None
    for _ in range(most_rounds):
        # large-star: neighbours larger than a node move to the least of its neighbours and itself
        arcs = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = arcs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: smaller neighbours and the node itself move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        both = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        both = checkpoint(both)
        now = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return both.select(F.col("a").alias("node"), F.col("b").alias("root")).union(both.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
