"""The same aggregates on streams: event-time windows with a watermark, running composition, and a bounded reservoir."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import symbols


def windowed_moments(stream: DataFrame, time: str, value: str, by: list[str], *, width: str, late: str) -> DataFrame:
    """start, the columns `by`, n and total of each window; rows later than the watermark are dropped, state is bounded by it."""
    w = F.window(F.col(time), width)
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs an instant
    return timed.withWatermark(time, late).groupBy(w.alias("_w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), *by, "n", "total")


def composition(stream: DataFrame, seq: str, by: list[str]) -> DataFrame:
    """Running residue counts; the state is groups x symbols. For update or complete mode."""
    one = stream.select(*by, F.explode(F.split(symbols.residues_only(F.col(seq)), "")).alias("res")).where("res <> ''")
    return one.groupBy(*by, "res").agg(F.count("*").alias("n"))


def reservoir_writer(path: str, m: int, key: str, *, seed: int) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps the m rows with the least seeded hash of all batches.

    Batch k reads the sample after batch k - 1 and writes `path`/k, so a repeated batch gives the same rows.
    """
    rank = F.xxhash64(F.lit(seed), key)

    def write(batch: DataFrame, k: int) -> None:
        rows = batch
        if k > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/{k - 1}"))
        rows.orderBy(rank, key).limit(m).write.mode("overwrite").parquet(f"{path}/{k}")

    return write


def run_to_end(stream: DataFrame, path: str, *, checkpoint: str) -> DataFrame:
    """Runs an aggregated stream over all input that is there, in complete mode, and returns the last result."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
