"""Plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word in the contracts: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Upper bounds of one Arrow batch: texts may be megabytes long, so rows alone do not bound memory.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lowers the session's Arrow batch bounds to at most `rows` rows and `size` bytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB") or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def text_udf(make: Callable[[], Callable[[Sequence[str | None]], dict[str, list]]], schema: str) -> Callable[..., Column]:
    """An Arrow-batched function of a text column that returns the struct `schema`.

    `make` is called once per task; what it returns maps the texts of a batch to columns.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for texts in batches:
            yield pd.DataFrame(work(list(texts)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, returnType=schema)


def per_text(docs: DataFrame, make: Callable[[], Callable[[Sequence[str | None]], dict[str, list]]], schema: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the columns of `schema`; every other input column is pruned."""
    bound_batches(docs.sparkSession)
    out = docs.select(F.col(id_col), text_udf(make, schema)(F.col(text_col)).alias("_r"))
    return out.select(id_col, "_r.*")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; only a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if folder is None and known.isDefined():
        folder = known.get()
    if folder is None:
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandframe-checkpoint-")
    if known.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
