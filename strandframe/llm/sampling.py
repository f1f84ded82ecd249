"""Bounded, repeatable samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's text, modulo `folds`; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(texts: DataFrame, labels: DataFrame, *, per_label: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> list[tuple[str, object]]:
    """(text, label) of at most `per_label` rows of each label, none held out, in a fixed order.

    The ids of a label fall into `per_label` buckets by hash, and each bucket keeps its least hash:
    one pass with sums before the shuffle, whatever the label's share of the rows. Texts with more
    than `most_chars` characters are not used for fitting, which bounds the driver's memory.
    """
    h = F.xxhash64(id_col)
    pool = labels.where((fold(id_col) != 0) & F.col(label_col).isNotNull()).select(id_col, label_col)
    picked = pool.groupBy(label_col, F.pmod(h, F.lit(per_label)).alias("_bucket")).agg(F.min_by(id_col, F.xxhash64(F.lit("pick"), id_col)).alias(id_col))
    rows = texts.select(id_col, text_col).where(F.length(text_col) <= most_chars).join(F.broadcast(picked.select(id_col, label_col)), id_col)
    return [(r[text_col], r[label_col]) for r in rows.select(id_col, text_col, label_col).dropDuplicates([id_col]).orderBy(id_col).collect()]
