"""Readers and writers of sequence files. Records are cut by Spark's own line reader, so large files are split among tasks.

Readers give name, accession, description, seq. White space inside sequences is dropped; an empty
sequence is kept as ''. Writers give one string column, one record a row, and `save` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("name", "accession", "description", "seq")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """`>name description` and sequence lines."""
    return _records(spark.read.text(path, lineSep="\n>"))


def _records(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(record, r"\A([^\n\r]*)", 1)
    return rows.select(
        F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"),
        F.lit("").alias("accession"),
        F.rtrim(F.regexp_extract(head, r"^\s*\S*[ \t]*(.*)$", 1)).alias("description"),
        _squeezed(F.expr("substr(regexp_replace(value, '^>', ''), length(regexp_extract(regexp_replace(value, '^>', ''), '\\\\A([^\\n\\r]*)', 1)) + 1)")).alias("seq"),
    )


def read_terminated(spark: SparkSession, path: str) -> DataFrame:
    """Records as of `read_fasta`, each ended by a line `//`, as a daemon is sent them; what stands behind the slashes is ignored, and so is a rest without a record."""
    rows = spark.read.text(path, lineSep="\n//").select(F.regexp_replace("value", r"\A[^>]*", "").alias("value"))
    return _records(rows)


def read_headed(spark: SparkSession, path: str) -> DataFrame:
    """Records as of `read_fasta` below one line `#` of counts, as a search daemon's database has it."""
    rows = spark.read.text(path, lineSep="\n>")
    return _records(rows.where(~F.rtrim("value").rlike(r"\A#[ \t]*\d+(?:[ \t]+\S+)*[ \t\r]*\z")))


def _flat(spark: SparkSession, path: str) -> DataFrame:
    """Records that end in a line `//`."""
    return spark.read.text(path, lineSep="\n//").select(F.regexp_replace("value", r"\A\s+", "").alias("r")).where("r <> ''")


def _joined(pattern: str) -> Column:
    """All matches of the group, joined by spaces."""
    return F.array_join(F.transform(F.regexp_extract_all("r", F.lit(pattern), 1), F.trim), " ")


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """EMBL and UniProt entries: ID, AC, DE and the lines after SQ."""
    return _flat(spark, path).select(
        F.regexp_extract("r", r"(?m)^ID\s+([^\s;]+)", 1).alias("name"),
        F.regexp_extract("r", r"(?m)^AC\s+([^\s;]+)", 1).alias("accession"),
        _joined(r"(?m)^DE\s+(.*)$").alias("description"),
        F.regexp_replace(F.regexp_extract("r", r"(?ms)^SQ [^\n]*\n(.*)", 1), r"[\s\d]+", "").alias("seq"),
    )


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """GenBank and DDBJ entries: LOCUS, ACCESSION, DEFINITION with its continuation lines, ORIGIN."""
    definition = F.regexp_extract("r", r"(?m)^DEFINITION\s+(.*(?:\n\s+.*)*)", 1)
    return _flat(spark, path).where(F.col("r").contains("LOCUS")).select(
        F.regexp_extract("r", r"(?m)^LOCUS\s+(\S+)", 1).alias("name"),
        F.regexp_extract("r", r"(?m)^(?:VERSION|ACCESSION)\s+(\S+)", 1).alias("accession"),
        F.trim(F.regexp_replace(definition, r"\s+", " ")).alias("description"),
        F.regexp_replace(F.regexp_extract("r", r"(?ms)^ORIGIN[^\n]*\n(.*)", 1), r"[\s\d]+", "").alias("seq"),
    )


READERS = {"fasta": read_fasta, "embl": read_embl, "uniprot": read_embl, "genbank": read_genbank, "ddbj": read_genbank, "daemon": read_terminated, "hmmpgmd": read_headed}


def read(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Reads `path` by the named format, or by what its first line looks like."""
    if form is None:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        line = first[0][0] if first else ">"
        form = "fasta" if line.startswith(">") else "hmmpgmd" if line.startswith("#") else "embl" if line.startswith("ID ") else "genbank" if line.startswith("LOCUS") else None
        if form is None:
            raise ValueError(f"unknown sequence format: {line[:40]!r}")
    return READERS[form](spark, path)


def wrapped(seq: Column, width: int) -> Column:
    return F.array_join(F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{width}}}"), 0), "\n")


def to_fasta(df: DataFrame, *, name: Column, seq: Column, description: Column | None = None, width: int = 60) -> DataFrame:
    head = F.concat(F.lit(">"), name) if description is None else F.concat(F.lit(">"), F.concat_ws(" ", name, F.when(description != "", description)))
    return df.select(F.concat_ws("\n", head, F.when(F.length(seq) > 0, wrapped(seq, width))).alias("value"))


def save(text: DataFrame, path: str) -> None:
    text.write.text(path)
