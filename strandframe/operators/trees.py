"""Trees of one alignment: agglomerative clustering, Newick text and tree weights. One task per alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

GAP = "-"
LINKAGES = ("average", "weighted", "single", "complete")


def cluster(d: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """(left, right, height) of each merge; nodes below n are leaves, n + k is merge k. Ties take the first pair of least node numbers."""
    if linkage not in LINKAGES:
        raise ValueError(linkage)
    n = len(d)
    size = 2 * n - 1 if n else 0
    work = np.full((size, size), np.inf)
    work[:n, :n] = d
    np.fill_diagonal(work, np.inf)
    members = np.ones(size)
    alive = np.zeros(size, bool)
    alive[:n] = True
    # for each node the nearest of those with greater numbers, the least of equals
    least, nearest = np.full(size, np.inf), np.zeros(size, int)

    def look(node: int) -> None:
        later = node + 1 + np.flatnonzero(alive[node + 1 :])
        least[node] = np.inf
        if len(later):
            nearest[node] = later[np.argmin(work[node, later])]
            least[node] = work[node, nearest[node]]

    for node in range(n):
        look(node)
    out = []
    for new in range(n, size):
        a = int(np.argmin(least))
        b = int(nearest[a])
        ids = np.flatnonzero(alive)
        height = work[a, b] / 2 if linkage in ("average", "weighted") else work[a, b]
        rest = ids[(ids != a) & (ids != b)]
        if linkage == "average":
            merged = (work[a, rest] * members[a] + work[b, rest] * members[b]) / (members[a] + members[b])
        elif linkage == "weighted":
            merged = (work[a, rest] + work[b, rest]) / 2
        else:
            merged = (np.minimum if linkage == "single" else np.maximum)(work[a, rest], work[b, rest])
        work[new, rest] = work[rest, new] = merged
        members[new] = members[a] + members[b]
        alive[[a, b]], alive[new] = False, True
        least[[a, b]] = np.inf
        stale = np.isin(nearest[rest], (a, b)) & np.isfinite(least[rest])
        for node in rest[stale]:
            look(node)
        closer = rest[merged < least[rest]]
        least[closer], nearest[closer] = work[closer, new], new
        out.append((int(a), int(b), float(height)))
    return out


def to_newick(names: Sequence[str], merges: Sequence[tuple[int, int, float]], digits: int = 6) -> str:
    text = list(names)
    height = [0.0] * len(text)
    for a, b, h in merges:
        text.append(f"({text[a]}:{round(h - height[a], digits)},{text[b]}:{round(h - height[b], digits)})")
        height.append(h)
    return (text[-1] if text else "") + ";"


def parse_newick(text: str) -> list[tuple[int, int | None, str, float]]:
    """(node, parent, name, length), the root first. Raises ValueError for text that is no tree."""
    rows: list[list] = [[0, None, "", 0.0]]
    node, word, after = 0, "", False

    def close() -> None:
        nonlocal word, after
        if after:
            rows[node][3] = float(word)
        elif word.strip():
            rows[node][2] = word.strip()
        word, after = "", False

    for k, c in enumerate(text):
        if c == "(":
            rows.append([len(rows), node, "", 0.0])
            node = len(rows) - 1
        elif c in ",);":
            close()
            if c == ";":
                if rows[node][1] is not None:
                    raise ValueError("open brackets at the end")
                return [tuple(r) for r in rows]
            if rows[node][1] is None:
                raise ValueError(f"unexpected {c} at {k}")
            node = rows[node][1]
            if c == ",":
                rows.append([len(rows), node, "", 0.0])
                node = len(rows) - 1
        elif c == ":":
            close()
            after = True
        else:
            word += c
    raise ValueError("no semicolon")


def clades(text: str) -> set[frozenset[str]]:
    """The sets of leaf names below the nodes of a tree in Newick form."""
    rows = parse_newick(text)
    below: dict[int, set[str]] = {node: set() for node, *_ in rows}
    inner = {parent for _, parent, *_ in rows}
    for node, parent, name, _ in reversed(rows):
        if node not in inner:
            below[node].add(name)
        if parent is not None:
            below[parent] |= below[node]
    return {frozenset(x) for x in below.values()}


def same_shape(a: str, b: str) -> bool:
    """Whether two rooted trees join the same names in the same way, whatever the order of branches and their lengths."""
    return clades(a) == clades(b)


def tree_weights(merges: Sequence[tuple[int, int, float]], n: int) -> np.ndarray:
    """Weights that sum to n: each branch's length goes to the leaves below it in proportion to what they hold."""
    if n == 0 or not merges:
        return np.ones(n)
    leaves = [[k] for k in range(n)]
    height = [0.0] * n
    w = np.zeros(n)
    for a, b, h in merges:
        for side in (a, b):
            ids = leaves[side]
            branch, held = h - height[side], w[ids].sum()
            w[ids] += branch * (w[ids] / held if held > 0 else 1 / len(ids))
        leaves.append(leaves[a] + leaves[b])
        height.append(h)
    return w * n / w.sum() if w.sum() > 0 else np.ones(n)


def difference(seqs: Sequence[str]) -> np.ndarray:
    """1 - identity by the shorter ungapped length, for all pairs of one alignment."""
    a = np.array([list(s) for s in seqs])
    held = a != GAP
    out = np.zeros((len(seqs), len(seqs)))
    for i in range(len(seqs)):
        same = ((a == a[i]) & held[i]).sum(axis=1)
        short = np.minimum(held.sum(axis=1), held[i].sum())
        out[i] = 1 - np.divide(same, short, out=np.zeros(len(seqs)), where=short > 0)
        out[i, i] = 0
    return out


def _per_alignment(rows: DataFrame, aln: str, key: str, aseq: Column, make, schema: str) -> DataFrame:
    part = rows.select(rows[aln].alias("aln"), rows[key].alias("key"), aseq.alias("s"))
    kind = {c: part.schema[c].dataType.simpleString() for c in ("aln", "key")}
    return part.groupBy("aln").applyInPandas(lambda pdf: make(pdf.sort_values("key").reset_index(drop=True)), schema.format(**kind))


def trees(rows: DataFrame, aln: str, key: str, aseq: Column, *, linkage: str = "average") -> DataFrame:
    """(aln, newick) of each alignment, leaves named by their keys."""
    make = lambda pdf: pd.DataFrame({"aln": pdf["aln"][:1], "newick": [to_newick([str(k) for k in pdf["key"]], cluster(difference(list(pdf["s"])), linkage))]})
    return _per_alignment(rows, aln, key, aseq, make, "aln {aln}, newick string")


def weights(rows: DataFrame, aln: str, key: str, aseq: Column) -> DataFrame:
    """(aln, key, weight) from the average-linkage tree."""
    make = lambda pdf: pd.DataFrame({"aln": pdf["aln"], "key": pdf["key"], "weight": tree_weights(cluster(difference(list(pdf["s"]))), len(pdf))})
    return _per_alignment(rows, aln, key, aseq, make, "aln {aln}, key {key}, weight double")


def cut(merges: Sequence[tuple[int, int, float]], n: int, parts: int) -> list[int]:
    """For each of n leaves its cluster, numbered from 0 by the least leaf, when the last merges are undone until `parts` clusters stand (fewer leaves: one each)."""
    if parts < 1:
        raise ValueError("at least one cluster is needed")
    root = list(range(n + len(merges)))
    for k in range(max(0, n - parts) - 1, -1, -1):
        a, b, _ = merges[k]
        root[a] = root[b] = root[n + k]
    seen: dict[int, int] = {}
    return [seen.setdefault(root[leaf], len(seen)) for leaf in range(n)]


def parts_with(merges: Sequence[tuple[int, int, float]], n: int, size: int) -> int:
    """The most clusters into which the tree can be cut so that one has `size` leaves or more; 1 if none ever has."""
    members = [1] * n
    for k, (a, b, _) in enumerate(merges):
        if max(members, default=0) >= size:
            return n - k
        members.append(members[a] + members[b])
    return 1


def partition(rows: DataFrame, aln: str, key: str, aseq: Column, parts: int | None = None, *, size: int | None = None, linkage: str = "single") -> DataFrame:
    """(aln, key, cluster): each alignment divided into so many clusters of its tree, or into as many as leave one with `size` rows."""
    if (parts is None) == (size is None):
        raise ValueError("either parts or size is needed")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        merges, n = cluster(difference(list(pdf["s"])), linkage), len(pdf)
        return pd.DataFrame({"aln": pdf["aln"], "key": pdf["key"], "cluster": cut(merges, n, parts if size is None else parts_with(merges, n, size))})

    return _per_alignment(rows, aln, key, aseq, make, "aln {aln}, key {key}, cluster int")
