"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Of two fingerprints within three bits at least one differing bit lies in some third of the 64 places,
so with that third left out two remain at most: each of the two is then within half the radius (one
bit) of a common variant. So for each third every fingerprint emits the rest of itself and all its
one-bit variants, 42 or 43 bits a key; the shuffle on the keys brings the two together, and pairs are
verified over all 64 bits. Keys that wide stay apart at 10^10 fingerprints and more.

A key that more than MANY fingerprints share would make too many pairs. Its members emit the whole
ball instead: their 64-bit variants within one bit, marked, and with two bits. Who meets a marked
member is within three bits of it by construction, and any two within three bits meet where one of
them is marked; so stars to the least marked member carry all links without making pairs. Equal
fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import bound_batches, checkpoint, per_text, text_udf
from strandframe.llm.components import components

SEED = 42
RADIUS = 3
#: (first place, places) of the thirds that are left out in turn.
THIRDS = ((0, 21), (21, 21), (42, 22))
#: Keys with more fingerprints than this are linked by balls and not by pairs.
MANY = 128
#: The rows of one fingerprint are dealt over so many tasks when they are named.
SALTS = 64
#: Components with over LARGE_NODES nodes, and with over one LARGE_ROOTS-th of all linked nodes, are named by a broadcast of at most LARGE_ROOTS rows.
LARGE_NODES = 1000
LARGE_ROOTS = 100_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint; 0 for null, empty and blank texts."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest, seed = xxhash.xxh64_digest, SEED
    hashes = np.frombuffer(b"".join([digest(p, seed) for p in parts]), dtype=np.uint8).reshape(-1, 8)
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):  # sums of up to 255 bits fit a byte
        counts += np.add.reduce(np.unpackbits(hashes[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprint_texts() -> Callable[[Sequence[str | None]], dict[str, list]]:
    def work(texts: Sequence[str | None]) -> dict[str, list]:
        return {"fp": [_signed(x) for x in map(fingerprint, texts)]}

    return work


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp, the fingerprint as a signed long, for each row."""

    return per_text(docs, _fingerprint_texts, "fp long", id_col=id_col, text_col=text_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys() -> list[tuple[int, int]]:
    """(kept places, flipped places) of every key: without a third, the rest and its one-bit variants. The third's own places hold its number."""
    out = []
    for k, (first, n) in enumerate(THIRDS):
        left_out = ((1 << n) - 1) << first
        rest = [0, *(1 << i for i in range(64) if not left_out >> i & 1)]
        out += [(~left_out & ((1 << 64) - 1), x | k << first) for x in rest]
    return out


def _flipped(rows: DataFrame, masks: Sequence[tuple[int, int]], name: str, *more: Column) -> DataFrame:
    """fp, `name` (the places kept, then flipped) and `more`, once for each mask."""
    array = F.array(*[F.struct(F.lit(_signed(k)).alias("k"), F.lit(_signed(x)).alias("x")) for k, x in masks])
    return rows.select("fp", *more, F.explode(array).alias("_m")).select("fp", F.col("fp").bitwiseAND(F.col("_m.k")).bitwiseXOR(F.col("_m.x")).alias(name), *[c for c in rows.columns if c != "fp"])


def links(fps: DataFrame, *, many: int = MANY) -> DataFrame:
    """Edges (a, b) between different fingerprints of `fps(fp)`, which holds each once: all links' components, and each edge is within RADIUS bits."""
    fp, every = F.col("fp"), (1 << 64) - 1
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= RADIUS
    edge = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    # both sides of the join have the same columns below the exchange, so that one exchange serves both
    keys = _flipped(fps.select("fp"), _keys(), "key").where("key IS NOT NULL AND fp IS NOT NULL").repartition("key")
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    members = keys.join(counts.hint("shuffle_hash"), "key").where(fp >= F.col("least"))
    # members of a key with many stand alone, the others in one list
    lists = members.groupBy("key", F.when(F.col("n") > many, fp).alias("alone")).agg(F.collect_list(F.when(F.col("n") <= many, fp)).alias("l"))
    others = lambda x, i: F.transform(F.filter(F.slice("l", i + 2, F.lit(many)), lambda y: near(x, y)), lambda y: edge(F.least(x, y), F.greatest(x, y)))
    alone = F.array(edge(F.col("alone"), F.lit(None).cast("long")))
    found = lists.select(F.inline(F.when(F.col("alone").isNotNull(), alone).otherwise(F.flatten(F.transform("l", others)))))
    found = checkpoint(found.distinct())
    pairs, dense = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("fp"))
    if dense.isEmpty():
        return pairs
    one = [(every, 0), *((every, 1 << i) for i in range(64))]
    two = [(every, 1 << i | 1 << j) for i in range(64) for j in range(i)]
    balls = _flipped(dense, one, "w").withColumn("marked", F.lit(True)).unionByName(_flipped(dense, two, "w").withColumn("marked", F.lit(False))).repartition("w")
    centres = balls.groupBy("w").agg(F.min(F.when(F.col("marked"), fp)).alias("a"), F.count("*").alias("n")).where("a IS NOT NULL AND n > 1").drop("n")
    stars = balls.join(centres.hint("shuffle_hash"), "w").where("fp <> a").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of `docs`: id, fp, root (a fingerprint that only this component has), component_id."""
    # a third of all rows may share a fingerprint: its rows are dealt over SALTS places, and each place is named once
    salt = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    marked = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col).withColumn("_salt", salt))
    places = checkpoint(marked.groupBy("fp", "_salt").agg(F.min(id_col).alias("first")))
    classes = checkpoint(places.groupBy("fp").agg(F.min("first").alias("first")))
    edges = links(classes.select("fp"))
    roots = components(edges)
    rooted = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "first")
    per = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    # components with more nodes than this are at most LARGE_ROOTS in number; the exchange by root is left to the others
    large = max(LARGE_NODES, (per.agg(F.sum("n")).first()[0] or 0) // LARGE_ROOTS)
    named = rooted.join(F.broadcast(per.where(F.col("n") > large).select("root", F.lit(True).alias("_large"), "component_id")), "root", "left")
    others = named.where("_large IS NULL").select("fp", "root").join(per.where(F.col("n") <= large).select("root", "component_id"), "root")
    named = named.where("_large").select("fp", "root", "component_id").unionByName(others.select("fp", "root", "component_id"))
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    named = places.select("fp", "_salt").join(named, "fp")
    return marked.join(named, ["fp", "_salt"]).select(id_col, "fp", "root", "component_id")


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id (the smallest id that can be reached over links, itself included).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows without an
    id are fingerprinted but never name a component; a component of such rows only has a null id.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    return _named(docs, id_col, text_col).select(id_col, _hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that name their component: one of each group of near-duplicates.

    Of rows that repeat an id one stays for each group that the id names, the first by text (null
    first). Rows without an id stay only where no row of the group has one; of these, too, the first
    by text. An empty table gives an empty result.
    """
    found = _named(docs, id_col, text_col)
    key = F.col(id_col)
    gone = checkpoint(found.where(key != F.col("component_id")).select(id_col).distinct())
    again = checkpoint(docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).select(id_col))
    kept = docs.where(key.isNotNull()).join(gone, id_col, "left_anti")
    if not again.isEmpty():
        # rows with a repeated id or none may lie in several groups, so the verdict on them goes by id and fingerprint
        bound_batches(docs.sparkSession)
        listed = again.select(key.alias("_id"))
        rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_id"), F.col(text_col).alias("_text"))
        rows = rows.join(listed.withColumnRenamed("_id", "_again"), F.col("_id").eqNullSafe(F.col("_again")), "left_semi").select("_row", "_id", "_text", text_udf(_fingerprint_texts, "fp long")(F.col("_text"))["fp"].alias("fp"))
        naming = found.where(key.eqNullSafe(F.col("component_id"))).select(key.alias("_name"), F.col("fp").alias("_fp"), "root")
        naming = checkpoint(naming.join(listed, F.col("_name").eqNullSafe(F.col("_id")), "left_semi").distinct())
        joined = rows.join(naming, F.col("_id").eqNullSafe(F.col("_name")) & (F.col("fp") == F.col("_fp")))
        first = joined.groupBy("_id", "root").agg(F.min_by("_row", F.struct(F.col("_text").isNotNull(), F.col("_text"))).alias("_row"))
        kept = kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(first.select("_row.*"))
    return kept.select(*docs.columns)
