"""Independent sets and splits on a link table, and maximum matching of small bipartite graphs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.draws import draw, uniform
from strandframe.functions.storage import checkpoint


def _both_ways(links: DataFrame) -> DataFrame:
    one = links.select("a", "b").where("a <> b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def independent_set(nodes: DataFrame, links: DataFrame, *, seed: int = 1, most_rounds: int = 100) -> DataFrame:
    """A maximal set of `nodes(node)` without a link between two of them.

    In each round a node whose seeded draw is below those of all its undecided neighbours enters,
    and its neighbours leave. So nodes decide together; the rounds are few with random ranks.
    """
    rank = F.struct(draw(seed, F.col("node")).alias("h"), "node")
    left = checkpoint(nodes.select("node").distinct().withColumn("rank", rank))
    arcs = checkpoint(_both_ways(links))
    chosen = left.select("node").limit(0)
    for _ in range(most_rounds):
        if left.isEmpty():
            return chosen
        ranked = left.select(F.col("node").alias("b"), F.col("rank").alias("other"))
        least = arcs.join(ranked, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("least"))
        new = checkpoint(left.join(least, "node", "left").where("least IS NULL OR rank < least").select("node"))
        gone = arcs.join(new.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).unionByName(new).distinct()
        left = checkpoint(left.join(gone, "node", "left_anti"))
        chosen = checkpoint(chosen.unionByName(new))
    raise RuntimeError(f"no end after {most_rounds} rounds")


def two_sets(nodes: DataFrame, links: DataFrame, *, share: float = 0.5, seed: int = 1, first: Column | None = None) -> DataFrame:
    """(node, side): a split with no link from side S to side T; the nodes of T that are linked to S are left out (side null). S is drawn by seed, or holds the nodes for which `first` is true."""
    in_s = uniform(seed, F.col("node")) < share if first is None else first
    sided = nodes.select("node", F.when(in_s, "S").otherwise("T").alias("side"))
    near = _both_ways(links).join(sided.where("side = 'S'").select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().withColumn("near", F.lit(True))
    return sided.join(near, "node", "left").select("node", F.when((F.col("side") == "S") | F.col("near").isNull(), F.col("side")).alias("side"))


def broken_links(sets: DataFrame, links: DataFrame, *, within: bool) -> DataFrame:
    """Links that a valid result must not have: inside the set of `sets(node)`, or, with within=False, between the sides S and T of `sets(node, side)`."""
    one = sets.select(F.col("node").alias("a"), *([] if within else [F.col("side").alias("_x")]))
    two = sets.select(F.col("node").alias("b"), *([] if within else [F.col("side").alias("_y")]))
    met = links.where("a <> b").join(one, "a").join(two, "b")
    return (met if within else met.where("_x <> _y")).select("a", "b")


def matching(n_left: int, links: Iterable[tuple[int, int]]) -> dict[int, int]:
    """left -> right of a maximum matching, by augmenting paths; for graphs that fit a task."""
    near: list[list[int]] = [[] for _ in range(n_left)]
    for a, b in links:
        near[a].append(b)
    holder: dict[int, int] = {}
    for start in range(n_left):
        # breadth first, so deep paths need no recursion
        came: dict[int, int] = {}
        queue, end = [start], None
        while queue and end is None:
            a = queue.pop(0)
            for b in near[a]:
                if b not in came:
                    came[b] = a
                    if b not in holder:
                        end = b
                        break
                    queue.append(holder[b])
        while end is not None:
            a = came[end]
            before = next((b for b, x in holder.items() if x == a), None)
            holder[end] = a
            if before is None or a == start:
                break
            end = before
    return {a: b for b, a in holder.items()}
