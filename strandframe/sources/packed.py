"""A packed sequence store: Parquet with two bits a nucleotide where a sequence is plain ACGT, and a sorted key index beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Residues in one packed long.
PER_WORD = 31


def pack(seq: Column) -> Column:
    """31 nucleotides in each long; null where the sequence holds anything but ACGT."""
    blocks = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{PER_WORD}}}"), 0)
    words = F.transform(blocks, lambda b: F.conv(F.translate(b, "ACGT", "0123"), 4, 10).cast("long"))
    return F.when(seq.rlike("^[ACGT]*$"), words)


def unpack(words: Column, n: Column) -> Column:
    return F.array_join(
        F.transform(words, lambda w, k: F.translate(F.lpad(F.conv(w.cast("string"), 10, 4), F.least(F.lit(PER_WORD), n - k * PER_WORD).cast("int"), F.lit("0")), "0123", "ACGT")), ""
    )


def write(df: DataFrame, path: str, *, key: str, seq: str, names: list[str], partitions: int) -> None:
    """`path`/data, range-partitioned and sorted by `key`, and `path`/keys: each value of the columns `names` with the data's key, sorted, so that a lookup prunes row groups."""
    rest = [c for c in df.columns if c != seq]
    data = df.select(*rest, pack(F.col(seq)).alias("_packed"), F.length(seq).alias("_n"), F.when(~F.col(seq).rlike("^[ACGT]*$"), F.col(seq)).alias("_plain"))
    data.repartitionByRange(partitions, key).sortWithinPartitions(key).write.parquet(f"{path}/data")
    pairs = df.select(F.explode(F.array_distinct(F.array(*[F.col(n).cast("string") for n in names]))).alias("name"), F.col(key).alias("_of")).where("name IS NOT NULL")
    pairs.repartitionByRange(partitions, "name").sortWithinPartitions("name").write.parquet(f"{path}/keys")


def read(spark: SparkSession, path: str) -> DataFrame:
    data = spark.read.parquet(f"{path}/data")
    rest = [c for c in data.columns if not c.startswith("_")]
    return data.select(*rest, F.coalesce("_plain", unpack(F.col("_packed"), F.col("_n"))).alias("seq"))


def fetch(spark: SparkSession, path: str, keys: DataFrame, *, key: str = "name") -> DataFrame:
    """Each requested `key` with n_found and the sequence (the least, if a key names several)."""
    found = keys.select(F.col("key").alias("name")).distinct().join(spark.read.parquet(f"{path}/keys"), "name").select(F.col("name").alias("_want"), "_of")
    hits = found.join(read(spark, path).select(F.col(key).alias("_of"), "seq"), "_of").groupBy("_want").agg(F.count("*").alias("n_found"), F.min("seq").alias("seq"))
    return keys.join(hits, keys["key"] == hits["_want"], "left").select("key", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), "seq")
