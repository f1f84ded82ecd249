"""Reliable checkpoints in the folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, or a temporary one in a local session without it."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and known.isDefined():
        named = known.get()
    if named is None:
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandframe-checkpoint-")
    if known.isEmpty():
        context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in that folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
