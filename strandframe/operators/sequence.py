"""Operators on tables of sequences, one row per sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandframe.functions import symbols
from strandframe.functions.draws import draw
from strandframe.functions.storage import checkpoint


def seq_stats(df: DataFrame, seq: str, by: list[str]) -> DataFrame:
    """nseq, nres, min_len, max_len and mean_len of each group; one partial and one final sum."""
    n = F.length(seq)
    return df.where(F.col(seq).isNotNull()).groupBy(*by).agg(F.count("*").alias("nseq"), F.sum(n).alias("nres"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"))


def residue_composition(df: DataFrame, seq: str, by: list[str]) -> DataFrame:
    """Count and frequency of each residue of each group. A batch of texts is counted by one array operation, so no row per residue is made."""
    counts = kmer_counts(df, seq, by, 1).withColumnRenamed("kmer", "res")
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


#: Letters of amino acids only, letters of all alphabets, other letters of amino acids, and the bounds of the decision.
AMINO_ONLY, COMMON, AMINO_OTHER = "EFIJLOPQZ", "ACG", "DHKMRSVWY"
LEAST_LETTERS, LEADING_N, MOST_OTHERS, LEAST_KINDS = 10, 2000, 0.02, 15


def guess_alphabet(df: DataFrame, seq: str, key: str) -> DataFrame:
    """dna, rna, amino or unknown for each sequence, by the kinds and shares of its letters.

    Amino acids need, without a letter of theirs alone, more letters that are no nucleotide than A, C
    and G together, and LEAST_KINDS kinds of letters (X is none).
    """
    s = symbols.residues_only(F.col(seq))
    n = F.length("_s")
    count = lambda letters: n - F.length(F.translate("_s", letters, ""))
    kinds = lambda letters: F.expr(" + ".join(f"cast(instr(_s, '{c}') > 0 AS int)" for c in letters))
    others = lambda letters: n - count(letters) <= MOST_OTHERS * n
    has = lambda letters: F.expr(" AND ".join(f"instr(_s, '{c}') > 0" for c in letters))
    out = (
        F.when(n <= LEAST_LETTERS, "unknown")
        .when((n > LEADING_N) & (count("N") == n), "dna")
        .when(count(AMINO_ONLY) > 0, "amino")
        .when(others(COMMON + "TN") & has(COMMON + "T"), "dna")
        .when(others(COMMON + "UN") & has(COMMON + "U"), "rna")
        .when(others(COMMON + AMINO_OTHER + "NTX") & (count(AMINO_OTHER) > count(COMMON)) & (kinds(COMMON + AMINO_OTHER + "NT") >= LEAST_KINDS), "amino")
        .otherwise("unknown")
    )
    return df.select(F.col(key), s.alias("_s")).select(key, out.alias("alphabet"), n.cast("long").alias("n_letters"))


def windows(df: DataFrame, seq: str, key: str, *, context: int, width: int) -> DataFrame:
    """Windows of `width` new residues with up to `context` residues before them: start (1-based, of the new residues), window."""
    if context > width:
        raise ValueError("context must not exceed width")
    # one pass cuts the text into blocks; a substring per window would scan the text again each time
    blocks = df.select(F.col(key), F.expr(f"regexp_extract_all(`{seq}`, '(?s).{{1,{width}}}', 0)").alias("_b")).where(F.size("_b") > 0)
    pairs = F.arrays_zip(F.concat(F.array(F.lit("")), F.slice("_b", F.lit(1), F.size("_b") - 1)).alias("before"), F.col("_b").alias("block"))
    each = blocks.select(key, F.posexplode(pairs).alias("_k", "_x"))
    return each.select(key, (F.col("_k") * width + 1).alias("start"), F.concat(F.expr(f"right(_x.before, {context})"), F.col("_x.block")).alias("window"))


DENSE_K = 3
#: Letters that are counted in one array operation; texts are taken together up to so many.
DENSE_LETTERS = 1 << 20
#: Groups times kinds of k-mers up to which counts are kept in one array; beyond it the k-mers are sorted.
DENSE_CELLS = 1 << 22


def _dense_kmers(df: DataFrame, seq: str, by: list[str], k: int) -> DataFrame:
    part = df.select(*by, symbols.residues_only(F.col(seq)).alias("_s")).where(F.length("_s") >= k)
    kinds = len(symbols.UPPER) ** k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(by)).to_pylist()
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))])) if by else [()] * len(texts)
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= DENSE_LETTERS):
                    size += len(texts[end])
                    end += 1
                groups: dict[tuple, int] = {}
                of = np.array([groups.setdefault(x, len(groups)) for x in keys[at:end]])
                sizes = np.array([len(t) for t in texts[at:end]])
                codes = np.frombuffer("".join(texts[at:end]).encode("ascii"), dtype=np.uint8).astype(np.int64) - ord("A")
                ends = np.repeat(np.cumsum(sizes), sizes)
                mers = codes[: len(codes) - k + 1]
                for i in range(1, k):
                    mers = mers * len(symbols.UPPER) + codes[i : len(codes) - k + 1 + i]
                whole = np.arange(len(mers)) + k <= ends[: len(mers)]
                places = (np.repeat(of, sizes)[: len(mers)] * kinds + mers)[whole]
                if len(groups) * kinds <= DENSE_CELLS:
                    n = np.bincount(places, minlength=1)
                    place = np.flatnonzero(n)
                    n = n[place]
                else:
                    place, n = np.unique(places, return_counts=True)
                listed = list(groups)
                columns = [pa.array([listed[g][i] for g in place // kinds], batch.schema.field(i).type) for i in range(len(by))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(place % kinds), pa.array(n)], names=[*by, "code", "n"])
                at = end

    schema = StructType([*[part.schema[c] for c in by], StructField("code", LongType()), StructField("n", LongType())])
    sums = part.mapInArrow(run, schema).groupBy(*by, "code").agg(F.sum("n").alias("n"))
    letter = lambda i: F.substring(F.lit(symbols.UPPER), (F.expr(f"code DIV {len(symbols.UPPER) ** (k - 1 - i)}") % len(symbols.UPPER) + 1).cast("int"), F.lit(1))
    return sums.select(*by, F.concat(*[letter(i) for i in range(k)]).alias("kmer"), "n")


def kmer_counts(df: DataFrame, seq: str, by: list[str], k: int) -> DataFrame:
    """Counts of the k-mers of letters in each group. Up to k = 3 a batch of texts is counted by one array operation, so no row per k-mer is made."""
    if k <= DENSE_K:
        return _dense_kmers(df, seq, by, k)
    s = df.select(*by, symbols.residues_only(F.col(seq)).alias("_s")).where(F.length("_s") >= k).select(*by, F.split("_s", "").alias("_s"))
    shifted = F.arrays_zip(*[F.slice("_s", F.lit(i + 1), F.size("_s") - (k - 1)).alias(f"s{i}") for i in range(k)])
    one = s.select(*by, F.explode(shifted).alias("_x")).select(*by, F.concat(*[F.col(f"_x.s{i}") for i in range(k)]).alias("kmer"))
    return one.groupBy(*by, "kmer").agg(F.count("*").alias("n"))


def markov_transitions(df: DataFrame, seq: str, by: list[str]) -> DataFrame:
    """First-order transition counts and conditional frequencies between letters."""
    pairs = kmer_counts(df, seq, by, 2).select(*by, F.substring("kmer", 1, 1).alias("src"), F.substring("kmer", 2, 1).alias("dst"), "n")
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "src")))


def even_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """first, last and n_rows of `parts` even runs of the key's order; the first runs take the remainder.

    Ranks come from a range partitioning: a row is ranked within its partition, and the partitions' row counts are summed.
    """
    ordered = df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    # written once: a second planning could cut the ranges at other places
    counted = checkpoint(ordered.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key))))
    sizes = counted.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0))  # one row per partition of the table
    before = sizes.select("_p", F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.sum("_n").over(w).alias("_total"))
    ranked = counted.join(F.broadcast(before), "_p").withColumn("_rank", F.col("_r") + F.coalesce("_before", F.lit(0)) - 1)
    size, extra = F.floor(F.col("_total") / parts), F.col("_total") % parts
    cut = extra * (size + 1)
    part = F.when(F.col("_rank") < cut, F.floor(F.col("_rank") / (size + 1))).otherwise(extra + F.floor((F.col("_rank") - cut) / F.greatest(size, F.lit(1))))
    return ranked.groupBy((part + 1).cast("long").alias("part")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n_rows"))


#: The standard genetic code in the order TTT, TTC, TTA, TTG, TCT ... with letters T, C, A, G.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


#: The public genetic codes by number, as what differs from the standard code, and the codons that may begin a protein.
GENETIC_CODES = {
    1: ("", "TTG CTG ATG"),
    2: ("AGA=* AGG=* ATA=M TGA=W", "ATT ATC ATA ATG GTG"),
    3: ("ATA=M CTT=T CTC=T CTA=T CTG=T TGA=W", "ATA ATG"),
    4: ("TGA=W", "TTA TTG CTG ATT ATC ATA ATG GTG"),
    5: ("AGA=S AGG=S ATA=M TGA=W", "TTG ATT ATC ATA ATG GTG"),
    6: ("TAA=Q TAG=Q", "ATG"),
    9: ("AAA=N AGA=S AGG=S TGA=W", "ATG GTG"),
    10: ("TGA=C", "ATG"),
    11: ("", "TTG CTG ATT ATC ATA ATG GTG"),
    12: ("CTG=S", "CTG ATG"),
    13: ("AGA=G AGG=G ATA=M TGA=W", "TTG ATA ATG GTG"),
    14: ("AAA=N AGA=S AGG=S TAA=Y TGA=W", "ATG"),
    16: ("TAG=L", "ATG"),
    21: ("TGA=W ATA=M AGA=S AGG=S AAA=N", "ATG GTG"),
    22: ("TCA=* TAG=L", "ATG"),
    23: ("TTA=*", "ATT ATG GTG"),
    24: ("AGA=S AGG=K TGA=W", "TTG CTG ATG GTG"),
    25: ("TGA=G", "TTG ATG GTG"),
    26: ("CTG=A", "CTG ATG"),
}


def codon_map(code: int = 1) -> dict[str, str]:
    """codon -> residue (* for a stop) of a genetic code by its public number."""
    if code not in GENETIC_CODES:
        raise ValueError(f"unknown genetic code {code}")
    standard = {a + b + c: STANDARD_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    return standard | dict(x.split("=") for x in GENETIC_CODES[code][0].split())


def translate_frames(df: DataFrame, dna: Column, key: str, *, strands: tuple[int, ...] = (1, -1), code: int = 1) -> DataFrame:
    """key, strand, frame (0 to 2), protein, by the genetic code of number `code`; X for codons with other letters. A null sequence has no rows."""
    residues, base = _codon_tables(code)[0::2]
    known = len(residues) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            data = "".join(texts.to_pylist()).encode("ascii", "replace")
            codes = base[np.frombuffer(data, dtype=np.uint8)]
            lengths = np.asarray(pc.utf8_length(texts), dtype=np.int64)
            begins = np.cumsum(lengths) - lengths
            read = np.full(len(codes), residues[known], dtype=np.uint8)  # the residue whose codon begins at each place
            if len(codes) > 2:
                a, b, c = codes[:-2], codes[1:-1], codes[2:]
                read[:-2] = residues[np.where(np.maximum(np.maximum(a, b), c) == known, known, a * 16 + b * 4 + c)]
            for frame in range(3):
                sizes = np.maximum(lengths - frame, 0) // 3
                ends = np.cumsum(sizes)
                within = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
                protein = read[np.repeat(begins + frame, sizes) + 3 * within]
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
                found = pa.LargeStringArray.from_buffers(len(sizes), offsets, pa.py_buffer(protein.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(sizes), frame, dtype=np.int32)), found], names=[key, "strand", "frame", "protein"])

    kind = df.schema[key].dataType.simpleString()
    return _strands(df, dna, key, strands).where("_s IS NOT NULL").mapInArrow(run, f"`{key}` {kind}, strand int, frame int, protein string")


def _codon_tables(code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the residue of each codon number (16, 4 and 1 times the letters' numbers), with X last; of marks M where it may begin a protein, else -; and the number of each letter's byte, or that of X."""
    letters, known = "TCAG", codon_map(code)
    codons = [a + b + c for a in letters for b in letters for c in letters]
    residues = np.frombuffer("".join(known[c] for c in codons).encode() + b"X", dtype=np.uint8)
    marks = np.frombuffer("".join("M" if c in GENETIC_CODES[code][1].split() else "-" for c in codons).encode() + b"-", dtype=np.uint8)
    base = np.full(256, len(codons), dtype=np.int64)
    for k, c in enumerate(letters):
        base[ord(c)] = k
    return residues, marks, base


def _strands(df: DataFrame, dna: Column, key: str, strands: tuple[int, ...]) -> DataFrame:
    """key, strand and its text _s."""
    rows = df.select(F.col(key), dna.alias("_d"))
    both = F.array(*[F.struct(F.lit(s).alias("strand"), (F.col("_d") if s > 0 else symbols.reverse_complement(F.col("_d"))).alias("_s")) for s in strands])
    return rows.select(key, F.explode(both).alias("_x")).select(key, "_x.strand", "_x._s")


def _reader(code: int) -> Callable[[str, int], tuple[str, str]]:
    """(protein, begins) of a strand from a frame on, by array operations; `begins` has an M at each residue whose codon may begin a protein and - at others."""
    residues, marks, base = _codon_tables(code)
    unknown = len(residues) - 1

    def read(text: str, frame: int) -> tuple[str, str]:
        codes = base[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]
        three = codes[frame : frame + max(0, len(codes) - frame) // 3 * 3].reshape(-1, 3)
        at = three @ np.array([16, 4, 1])
        at[(three == unknown).any(axis=1)] = unknown
        return residues[at].tobytes().decode(), marks[at].tobytes().decode()

    return read


def _frames(df: DataFrame, dna: Column, key: str, strands: tuple[int, ...], code: int, each: Callable[[str, str, int], list[dict]], schema: str) -> DataFrame:
    """key, strand and what `each` lists of (protein, begins, frame) of every frame, in Arrow batches."""
    read = _reader(code)

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda text: None if text is None else [x for f in range(3) for x in each(*read(text, f), f)], na_action="ignore")

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    listed = F.pandas_udf(run, returnType=f"array<struct<{schema}>>")(F.col("_s"))
    return _strands(df, dna, key, strands).select(key, "strand", F.explode(listed).alias("_f")).select(key, "strand", "_f.*")


def open_reading_frames(df: DataFrame, dna: Column, key: str, *, least: int = 20, strands: tuple[int, ...] = (1, -1), code: int = 1, from_start: bool = False) -> DataFrame:
    """key, strand, frame, at (1-based residue in the frame's protein), orf: stretches of at least `least` residues without a stop.

    With `from_start` a stretch begins at its first codon that the genetic code lets begin a protein,
    which is read as M; stretches without one are left out. A frame is read once, whatever its length.
    """

    def each(protein: str, begins: str, frame: int) -> list[dict]:
        out, at = [], 0
        for part in protein.split("*"):
            first = begins.find("M", at, at + len(part)) if from_start else at
            if first >= 0:
                orf = "M" + part[first - at + 1 :] if from_start else part
                if len(orf) >= least:
                    out.append({"frame": frame, "at": first + 1, "orf": orf})
            at += len(part) + 1
        return out

    return _frames(df, dna, key, strands, code, each, "frame:int,at:bigint,orf:string")


def fetch_by_key(keys: DataFrame, table: DataFrame, key: str, names: list[str], payload: list[str], *, strict: bool = False) -> DataFrame:
    """One row per requested key: key, n_found and the columns of `payload`, all of one row (the least, if several match).

    A key matches any of the columns `names`; a row that matches by several counts once, and equal
    rows count each. With `strict` a key that does not name exactly one row is an error.
    """
    each = table.select(F.explode(F.array_distinct(F.array(*[F.col(n) for n in names]))).alias("_key"), F.struct(*payload).alias("_row")).where(F.col("_key").isNotNull())
    found = each.groupBy("_key").agg(F.count("*").alias("n_found"), F.min("_row").alias("_row"))
    out = keys.select(key).join(found, F.col(key) == F.col("_key"), "left")
    n = F.coalesce("n_found", F.lit(0)).cast("long")
    if strict:
        n = F.when(n == 1, n).otherwise(F.raise_error(F.concat(F.lit("key "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" names "), n.cast("string"), F.lit(" rows"))).cast("long"))
    return out.select(key, n.alias("n_found"), *[F.col("_row").getField(c).alias(c) for c in payload])


def sample_rows(df: DataFrame, m: int, *, seed: int, key: str) -> DataFrame:
    """m rows, repeatable: those with the least draws by seed and key; each task keeps m at most."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(m)
