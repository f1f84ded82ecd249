"""Benchmark decontamination by spaced seeds, in built-in functions only.

A seed is the hash of four words at fixed places in a window of five; the place between them is
ignored, so a substituted word there does not break it. Seeds of benchmark items and of documents are
joined; a hit names a diagonal, on which all words of the item are compared. An item counts as leaked
if at least 80 % of its words stand on one diagonal, or near strong hits on several (words put in or left out).

No pattern of substitutions at 80 % escapes: an item of n words has n DIV 5 windows side by side and
at most as many substituted words, so one window has at most one, and some mask steps over it. Items
of one to four words have no such window; they count where all their words stand in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places in a window of five words that each mask looks at: with one word substituted, some mask still fits.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
LEAST_WORDS = 5
LEAST_SHARE = 0.8
#: Strong hits: five equal words of one diagonal at these places. Words near them are put together over several diagonals.
STRONG = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 7))
STRONG_SPAN = 1 + max(p for m in STRONG for p in m)
#: Words before and after a strong hit's window that count as near.
REACH = 8
#: Places in one word of bits.
BITS = 62
#: Benchmarks with more words than this are joined by a shuffle and not broadcast.
BROADCAST_WORDS = 400_000


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of the words: runs of letters and digits, lower case. Null gives an empty array."""
    # a separator in front keeps the first word apart from the empty one that the split gives there
    words = F.split(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}]+")
    return F.slice(F.transform(words, lambda w: F.xxhash64(w)), F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))


def _seeds(rows: DataFrame, words: str, short: tuple[int, ...]) -> DataFrame:
    """The rows once for each seed, with `at`, the place of its window, `mask`, its number (after MASKS those of items with as many words as `short` lists), and `seed`; all within generated code."""
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    need = sorted({p for m in masks for p in m})
    shifted = ", ".join(f"slice({words}, {p + 1}, size({words}))" for p in need[1:])
    cols = {p: f"_g.`{k}`" if k else f"_g.`{words}`" for k, p in enumerate(need)}
    windows = rows.withColumn("_g", F.explode(F.expr(f"arrays_zip({words}, {shifted}, sequence(0, greatest(size({words}) - 1, 0)))")))
    hashed = [F.expr(f"if({cols[max(m)]} IS NULL OR {cols[0]} IS NULL, null, xxhash64({i}, {', '.join(cols[p] for p in m)}))") for i, m in enumerate(masks)]
    at = F.col(f"_g.`{len(need)}`").alias("at")
    return windows.select(*rows.columns, at, F.posexplode(F.array(*hashed)).alias("mask", "seed")).where(F.col("seed").isNotNull())


def benchmark_items(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (the least id of equal texts), item_words, n_item. Items without a word and rows without an id are left out."""
    hashed = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), word_hashes(F.col(text_col)).alias("item_words"))
    return hashed.groupBy("item_words").agg(F.min("item").alias("item")).select("item", "item_words", F.size("item_words").alias("n_item")).where("n_item > 0")


def _found(met: DataFrame, words: str, least_share: float) -> DataFrame:
    """(_doc, _th, item, n_item, whole, place): for each diagonal the share of all the item's words that stand on it, and the places near its strong hits. `words` holds the document's words from `base` on; a short item's hit is a whole one."""
    short = f"n_item < {LEAST_WORDS}"
    same = F.expr(f"if({short}, array(), transform(sequence(0, n_item - 1), p -> coalesce(get({words}, cast(p + diagonal - base AS int)) = get(item_words, p), false)))")
    rows = met.withColumn("same", same).withColumn("whole", F.expr(f"if({short}, 1.0D, size(filter(same, x -> x)) / n_item)"))
    strong = " OR ".join("(" + " AND ".join(f"coalesce(get(same, x + {p}), false)" for p in m) + ")" for m in STRONG)
    rows = rows.withColumn("strong", F.expr(f"if({short}, array(), transform(sequence(0, n_item - 1), x -> {strong}))")).withColumn("any", F.expr("exists(strong, x -> x)"))
    near = f"exists(slice(strong, greatest(p - {STRONG_SPAN + REACH - 1}, 0) + 1, p + {REACH} + 1 - greatest(p - {STRONG_SPAN + REACH - 1}, 0)), x -> x)"
    places = F.expr(f"if(any, filter(sequence(0, n_item - 1), p -> get(same, p) AND {near}), array())")
    return rows.where(F.col("any") | (F.col("whole") >= least_share)).select("_doc", "_th", "item", "n_item", "whole", F.explode_outer(places).alias("place"))


def _row_hash(text_col: str) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(text_col))


def _leaks(docs: DataFrame, benchmark: DataFrame, least_share: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """_doc (the id, null included), _th (the hash of the text), item, share."""
    items = benchmark_items(benchmark, id_col=item_col, text_col=item_text_col)
    words = docs.select(F.col(id_col).alias("_doc"), _row_hash(text_col).alias("_th"), word_hashes(F.col(text_col)).alias("w"))
    few = f"n_item < {LEAST_WORDS}"
    n_words, short = items.limit(BROADCAST_WORDS + 1).agg(F.coalesce(F.sum("n_item"), F.lit(0)), F.collect_set(F.expr(f"if({few}, n_item, null)"))).first()
    small = n_words <= BROADCAST_WORDS
    short = tuple(sorted(short)) if small else tuple(range(1, LEAST_WORDS))
    # of a short item only the seed of all its words counts, of others only those of the masks
    length = F.expr("CASE " + " ".join(f"WHEN mask = {len(MASKS) + k} THEN {n}" for k, n in enumerate(short)) + " END") if short else F.lit(None).cast("int")
    seeds = _seeds(items, "item_words", short).where(F.coalesce(length == F.col("n_item"), F.expr(f"mask < {len(MASKS)} AND NOT {few}")))
    seeds = seeds.withColumnRenamed("at", "item_at").withColumn("before", F.expr("get(item_words, item_at - 1)")).drop("item_words", "mask")
    # wherever a short item stands, it is one find
    diagonal = F.expr(f"if({few}, 0, at - item_at)").alias("diagonal")
    if small:
        # only the document's words on the diagonal leave the stage that made the hit; where the words before a hit are equal too, some mask hits one place earlier
        hits = _seeds(words, "w", short).join(F.broadcast(seeds), "seed").where("coalesce(get(w, at - 1) <> before, true)")
        base = F.expr(f"if({few}, 0, greatest(at - item_at, 0))")
        met = hits.select("_doc", "_th", "item", diagonal, base.alias("base"), F.when(F.expr(f"NOT {few}"), F.slice("w", base + 1, F.col("n_item"))).alias("near")).distinct()
        found = _found(met.join(F.broadcast(items), "item"), "near", least_share)
    else:
        met = _seeds(words, "w", short).select("_doc", "_th", "at", "seed").join(seeds.select("seed", "item", "item_at", "n_item"), "seed").select("_doc", "_th", "item", diagonal).distinct()
        held = words.withColumnsRenamed({"_doc": "_d", "_th": "_t"})
        found = _found(met.join(items, "item").join(held, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))).withColumn("base", F.lit(0)), "w", least_share)
    bit = F.expr(f"shiftleft(1L, place % {BITS})")
    bits = found.groupBy("_doc", "_th", "item", "n_item", F.expr(f"place DIV {BITS}").alias("part")).agg(F.bit_or(bit).alias("bits"), F.max("whole").alias("whole"))
    near = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)) / F.col("n_item")
    return bits.groupBy("_doc", "_th", "item", "n_item").agg(F.greatest(F.max("whole"), near).alias("share")).where(F.col("share") >= least_share).select("_doc", "_th", "item", "share")


def leaked_items(docs: DataFrame, benchmark: DataFrame, *, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document id (null is one, too) and leaked item: doc, item, share (the largest of the id's rows, of the item's words that are found).

    An empty benchmark, an empty table, null texts and texts without a word give no row.
    """
    leaks = _leaks(docs, benchmark, least_share, id_col, text_col, item_col, item_text_col)
    return leaks.groupBy(F.col("_doc").alias("doc"), "item").agg(F.max("share").alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, contaminated, n_items, item_ids (sorted; of equal items the least id), share (the largest; 0 if none).

    Null and empty texts are clean. Each row is judged by its own text, also where rows repeat an id
    or have none. An empty benchmark leaves all clean, an empty table gives an empty result, and
    other columns are ignored.
    """
    leaks = _leaks(docs, benchmark, least_share, id_col, text_col, item_col, item_text_col)
    per = leaks.groupBy("_doc", "_th").agg(F.sort_array(F.collect_set("item")).alias("_items"), F.max("share").alias("_share"))
    rows = docs.select(F.col(id_col).alias("_id"), _row_hash(text_col).alias("_hash"))
    out = rows.join(per, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_th")), "left")
    ids = F.coalesce("_items", F.array().cast(per.schema["_items"].dataType))
    return out.select(F.col("_id").alias(id_col), F.col("_th").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("_share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item; each row is judged by its own text, whatever its id. An empty benchmark keeps all rows."""
    leaks = _leaks(docs, benchmark, least_share, id_col, text_col, item_col, item_text_col).select("_doc", "_th").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), _row_hash(text_col).alias("_hash"))
    return rows.join(leaks, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_th")), "left_anti").select("_row.*")
