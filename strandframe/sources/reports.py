"""Search reports: one row per alignment or per ranked target, and the line formats written from them.

A report is cut into one record per query by the reader's line separator, so a file with many queries
is read in splits; the blocks of a query are then cut and read by built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What begins a query's record in each kind of report (fixed values of the formats).
SEPARATORS = {"blast": "\nQuery=", "profile": "\nQuery:", "fasta": ">>>"}


def _records(spark: SparkSession, path: str, form: str) -> DataFrame:
    return spark.read.option("lineSep", SEPARATORS[form]).text(path).select(F.regexp_replace("value", "\r", "").alias("_v"))


def _get(text: str | Column, pattern: str, kind: str = "string", group: int = 1) -> Column:
    """A group of the first match as `kind`; null without a match."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).try_cast(kind)


def _number(text: Column) -> Column:
    """A double; a bare exponent such as e-100 has a mantissa of 1."""
    return F.regexp_replace(text, "^e", "1e").try_cast("double")


def _ends(text: str, label: str) -> tuple[Column, Column]:
    """First start and last end of the numbered lines of an alignment."""
    pattern = rf"(?m)^{label}:?\s+(\d+)\s+\S+\s+(\d+)\s*$"
    starts, ends = (F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.try_element_at(starts, F.lit(1)).try_cast("int"), F.try_element_at(ends, F.lit(-1)).try_cast("int")


def _blocks(df: DataFrame, pattern: str) -> DataFrame:
    """One row per block that begins with `pattern`, in order; what precedes the first is dropped."""
    return df.select("query", F.posexplode(F.split("_v", pattern)).alias("_at", "_b")).where("_at > 0")


def blast_alignments(spark: SparkSession, path: str) -> DataFrame:
    """query, target, description, score (bits), evalue, pct_id, qstart, qend, tstart, tend of each alignment of a pairwise report, in either of its two dialects."""
    named = _records(spark, path, "blast").where(F.col("_v").rlike(r"\n>")).select(F.coalesce(_get("_v", r"^[ \t]*(\S+)"), F.lit("unnamed_query")).alias("query"), "_v")
    targets = _blocks(named, r"\n>").select("query", _get("_b", r"^\s*(\S+)").alias("target"), F.trim(F.regexp_extract("_b", r"^\s*\S+[ \t]*([^\n]*)", 1)).alias("description"), "_b")
    parts = targets.select("query", "target", "description", F.posexplode(F.split("_b", r"\n Score =")).alias("_at", "_a")).where("_at > 0")
    bits = F.coalesce(_get("_a", r"^\s*(\S+) bits", "double"), _get("_a", r"^\s*\d+ \((\S+) bits\)", "double"))
    (qs, qe), (ts, te) = _ends("_a", "Query"), _ends("_a", "Sbjct")
    evalue = _number(_get("_a", r"Expect(?:\(\d+\))?\s+=\s+([^\s,]+)"))
    return parts.select("query", "target", "description", bits.alias("score"), evalue.alias("evalue"), _get("_a", r"Identities = \d+/\d+ \((\d+)%\)", "double").alias("pct_id"), qs.alias("qstart"), qe.alias("qend"), ts.alias("tstart"), te.alias("tend"))


def profile_alignments(spark: SparkSession, path: str) -> DataFrame:
    """The same columns for each domain of a profile-search report; evalue is the conditional one and there is no identity."""
    named = _records(spark, path, "profile").select(_get("_v", r"^\s*(\S+)\s+\[[LM]=\d+\]").alias("query"), "_v").where("query IS NOT NULL")
    # rows of a domain table: number, mark, score, bias, two E-values and three ranges, each closed by a pair of marks
    line = r"(?m)^\s*\d+ \S\s+(\S+\s+\S+\s+\S+\s+\S+\s+\d+\s+\d+ \S\S\s+\d+\s+\d+) \S\S\s+\d+\s+\d+ \S\S\s+\S+\s*$"
    rows = _blocks(named, r"\n>>").select("query", _get("_b", r"^\s*(\S+)").alias("target"), F.explode(F.regexp_extract_all("_b", F.lit(line), F.lit(1))).alias("_l"))
    f = lambda i, kind: F.try_element_at(F.split("_l", r"\s+"), F.lit(i)).try_cast(kind)
    return rows.select("query", "target", F.lit("").alias("description"), f(1, "double").alias("score"), f(3, "double").alias("evalue"), F.lit(0.0).alias("pct_id"), f(5, "int").alias("qstart"), f(6, "int").alias("qend"), f(8, "int").alias("tstart"), f(9, "int").alias("tend"))


def fasta_alignments(spark: SparkSession, path: str) -> DataFrame:
    """The same columns for each alignment of a report whose queries begin with >>> and targets with >>."""
    named = _records(spark, path, "fasta").where(F.col("_v").rlike(r"\n>>")).select(_get("_v", r"^(\S+?),?\s").alias("query"), "_v")
    overlap = r"(\d+)-(\d+):(\d+)-(\d+)\)"
    rows = _blocks(named, r"\n>>").select(
        "query", _get("_b", r"^(\S+)").alias("target"), F.trim(F.regexp_extract("_b", r"^\S+[ \t]*([^\n]*?)\s*\(\s*\d+ aa\)", 1)).alias("description"),
        _get("_b", r"bits:\s*(\S+)", "double").alias("score"), _number(_get("_b", r"E\(\d*\):\s*(\S+)")).alias("evalue"), F.floor(_get("_b", r"([\d.]+)% identity", "double")).cast("double").alias("pct_id"),
        *[_get("_b", overlap, "int", g).alias(n) for g, n in enumerate(("qstart", "qend", "tstart", "tend"), 1)],
    )
    return rows.where("qstart IS NOT NULL")


def ranked_targets(spark: SparkSession, path: str, form: str) -> DataFrame:
    """query, target, score (bits), evalue of each line of the hit lists of a report of kind `form`."""
    heading, name = {
        "blast": (r"Sequences producing [^\n]*\n\s*\n", r"^[ \t]*(\S*)"),
        "profile": (r"Scores for complete sequences [^\n]*\n[^\n]*\n[^\n]*\n[^\n]*\n", r"^\s*(\S+)"),
        "fasta": (r"The best scores are:[^\n]*\n", r"^(\S+?),?\s"),
    }[form]
    listed = _records(spark, path, form).select(_get("_v", name).alias("query"), F.try_element_at(F.split("_v", heading, 2), F.lit(2)).alias("_l")).where("_l IS NOT NULL")
    block = F.try_element_at(F.split("_l", r"\n\s*\n", 2), F.lit(1))
    lines = listed.select("query", F.explode(F.filter(F.split(block, "\n"), lambda x: ~x.rlike(r"^\s*$|^\s*-+ inclusion threshold"))).alias("_l"))
    row, target, score, evalue = {
        "blast": (r"^\s*\S+\s+.+\s\S+\s+\S+\s*$", _get("_l", r"^\s*(\S+)"), _get("_l", r"\s(\S+)\s+\S+\s*$", "double"), _number(_get("_l", r"(\S+)\s*$"))),
        "profile": (r"^(\s*\S+){8}", _get("_l", r"^(?:\s*\S+\s){8}\s*(\S+)"), _get("_l", r"^\s*\S+\s+(\S+)", "double"), _number(_get("_l", r"^\s*(\S+)"))),
        "fasta": (r"\(\s*\d+\)", _get("_l", r"^(\S+)"), _get("_l", r"\s(\S+)\s+\S+\s*$", "double"), _number(_get("_l", r"(\S+)\s*$"))),
    }[form]
    return lines.where(F.col("_l").rlike(row)).select("query", target.alias("target"), score.alias("score"), evalue.alias("evalue"))


def to_lines(hits: DataFrame, form: str, *, source: str = ".", feature: str = "match") -> DataFrame:
    """`value` lines of alignments as exblx, tbl or gff, or of ranked targets as profmark; fields are parted by tabs."""
    c, whole = F.col, F.format_string("%d", F.col("pct_id").cast("long")) if "pct_id" in hits.columns else F.lit("")
    text = lambda *names: [c(n).cast("string") for n in names]
    fields = {
        "exblx": lambda: [c("evalue").cast("string"), whole, *text("tstart", "tend", "target", "qstart", "qend", "query")],
        "tbl": lambda: [c("evalue").cast("string"), whole, *text("qstart", "qend", "query", "tstart", "tend", "target", "description")],
        "gff": lambda: [c("target"), F.lit(source), F.lit(feature), *text("tstart", "tend"), F.format_string("%.1f", c("score")), F.when(c("qstart") > c("qend"), "-").otherwise("+"), F.lit("."), F.format_string('gene "%s"', c("query"))],
        "profmark": lambda: [c("evalue").cast("string"), F.format_string("%.1f", c("score")), *text("target", "query")],
    }
    if form not in fields:
        raise ValueError(f"unknown form {form}")
    return hits.select(F.concat_ws("\t", *[F.coalesce(x, F.lit("")) for x in fields[form]()]).alias("value"))


def filtered(hits: DataFrame, *, most_evalue: float | None = None, least_score: float | None = None, least_length: int | None = None, most_length: int | None = None) -> DataFrame:
    """Hits within the given bounds; a hit's length is that of its range on the target."""
    length = F.abs(F.col("tend") - F.col("tstart")) + 1
    for value, test in ((most_evalue, lambda v: F.col("evalue") <= v), (least_score, lambda v: F.col("score") >= v), (least_length, lambda v: length >= v), (most_length, lambda v: length <= v)):
        if value is not None:
            hits = hits.where(test(value))
    return hits
