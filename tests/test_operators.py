import math
import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import symbols
from strandframe.operators import alignment, numeric, pairwise, sequence


def weights(spark, rows):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(rows)], "aln int, key int, s string")
    res = alignment.residue_table(df, "aln", "key", F.col("s"))
    return [round(r.weight, 4) for r in alignment.position_weights(res).orderBy("key").collect()]


def test_position_weights_of_known_alignments(spark):
    assert weights(spark, ["AAAAA"] * 5) == [1.0] * 5
    assert weights(spark, ["AAAAA", "AAAAA", "CCCCC", "CCCCC", "TTTTT"]) == [0.8333] * 4 + [1.6667]
    assert weights(spark, ["GYVGS", "GFDGF", "GYDGF", "GYQGG"]) == [1.0667, 1.0667, 0.8, 1.0667]


def test_cluster_weights(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["GYVGS", "GFDGF", "GYDGF", "GYQGG"])], "aln int, key int, s string")
    pairs = pairwise.pair_table(df, "aln", "key", F.col("s"))
    found = pairwise.cluster_weights(pairwise.identity_clusters(pairs, df, "aln", "key", 0.62)).orderBy("key").collect()
    assert [round(r.weight, 4) for r in found] == [1.3333, 0.6667, 0.6667, 1.3333]


def test_gumbel_fit_finds_the_parameters(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(20 - math.log(-math.log(rng.random())) / 0.4,) for _ in range(20000)], "x double")
    fit = numeric.fit_gumbel(df, "x").first()
    assert abs(fit.mu - 20) < 0.1 and abs(fit["lambda"] - 0.4) < 0.02


def test_open_reading_frames_against_a_loop(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 400))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, s string")
    got = {tuple(r) for r in sequence.open_reading_frames(df, F.col("s"), "k", least=8).collect()}
    want, code = set(), sequence.codon_map()
    for k, s in enumerate(seqs):
        for strand in (1, -1):
            t = s if strand > 0 else s[::-1].translate(str.maketrans("ACGT", "TGCA"))
            for frame in range(3):
                at = 1
                for part in "".join(code[t[i : i + 3]] for i in range(frame, len(t) - 2, 3)).split("*"):
                    if len(part) >= 8:
                        want.add((k, strand, frame, at, part))
                    at += len(part) + 1
    assert got == want


def test_windows_carry_context(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "k int, s string")
    got = [tuple(r) for r in sequence.windows(df, "s", "k", context=2, width=4).orderBy("start").collect()]
    assert got == [(1, 1, "abcd"), (1, 5, "cdefgh"), (1, 9, "ghij")]


def test_identity_filter_keeps_the_first(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["AAAA", "AAAC", "CCCC", "----"])], "aln int, key int, s string")
    assert sorted(r.key for r in pairwise.identity_filter(df, "aln", "key", F.col("s"), 0.75).collect()) == [0, 2, 3]


def test_reverse_complement_twice_is_the_input(spark):
    df = spark.createDataFrame([("ACGTRYKMN",)], "s string")
    assert df.select(symbols.reverse_complement(symbols.reverse_complement(F.col("s")))).first()[0] == "ACGTRYKMN"


def test_alphabets_need_more_amino_letters_than_common_ones(spark):
    rows = [("a", "ACG" * 20 + "DHKMRSVWYNTX"), ("b", "DHKMRSVWY" * 20 + "ACGNT"), ("c", "N" * 2001), ("d", "ACGT" * 3), ("e", "ACGU" * 3), ("f", "ACGTE" * 4), ("g", "ACGT"), ("h", "DHKMRSVWYACG" * 9 + "X" * 9)]
    got = sequence.guess_alphabet(spark.createDataFrame(rows, "k string, s string"), "s", "k").collect()
    assert {r.k: r.alphabet for r in got} == {"a": "unknown", "b": "unknown", "c": "dna", "d": "dna", "e": "rna", "f": "amino", "g": "unknown", "h": "unknown"}


def test_fetched_columns_are_of_one_row(spark):
    table = spark.createDataFrame([(1, 9, "a", "z"), (1, 8, "b", "y"), (2, 2, None, "q"), (3, 7, "c", "c"), (3, 7, "c", "c")], "x int, y int, p string, q string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "k int")
    got = {r.k: tuple(r)[1:] for r in sequence.fetch_by_key(keys, table, "k", ["x", "y"], ["p", "q"]).collect()}
    assert got == {1: (2, "a", "z"), 2: (1, None, "q"), 3: (2, "c", "c"), 4: (0, None, None), None: (0, None, None)}
    with pytest.raises(Exception, match="key 3 names 2 rows"):
        sequence.fetch_by_key(keys.where("k = 3"), table, "k", ["x", "y"], ["p"], strict=True).collect()


def test_reading_frames_from_a_start(spark):
    df = spark.createDataFrame([(1, "CCCTTGAAACCCATGTAACCCATG")], "k int, s string")
    got = lambda **kw: {tuple(r)[3:] for r in sequence.open_reading_frames(df, F.col("s"), "k", least=1, strands=(1,), **kw).where("frame = 0").collect()}
    assert got() == {(1, "PLKPM"), (7, "PM")}
    assert got(from_start=True) == {(2, "MKPM"), (8, "M")} and got(from_start=True, code=3) == {(5, "M"), (8, "M")}
    assert sequence.codon_map(2)["TGA"] == "W" and sequence.codon_map(14)["TAA"] == "Y"
    with pytest.raises(ValueError):
        sequence.codon_map(7)


def test_summary_spread_counts_and_equality(spark):
    rows = spark.createDataFrame([("x", k, "ACGT-" * 4 if k % 2 else "ACGA-" * 4) for k in range(60)] + [("y", 1, "A-")], "aln string, key int, s string")
    got = {r.aln: r for r in alignment.summary(rows, "aln", "key", F.col("s")).collect()}
    assert tuple(got["x"])[1:6] == (60, 20, 960, 16, 16) and abs(got["x"].pid - 0.873) < 0.02 and got["y"].pid is None
    every = {r.aln: r for r in alignment.summary(rows, "aln", "key", F.col("s"), most_pairs=None).collect()}
    assert abs(every["x"].pid - (870 + 900 * 0.75) / 1770) < 1e-9
    res = alignment.residue_table(spark.createDataFrame([("x", 1, "aN"), ("x", 2, "R-")], "aln string, key int, s string"), "aln", "key", F.col("s"))
    weights = spark.createDataFrame([("x", 1, 3.0)], "aln string, key int, weight double")
    assert {(r.col, r.res): r.n for r in alignment.spread_counts(res, "dna", weights=weights).collect()} == {(1, "A"): 3.5, (1, "G"): 0.5, (2, "A"): 0.75, (2, "C"): 0.75, (2, "G"): 0.75, (2, "T"): 0.75}
    assert alignment.differing(rows, rows.withColumn("s", F.lower("s")), "aln", "key", "s").isEmpty()


def test_pairs_do_not_depend_on_tiles(spark):
    rows = spark.createDataFrame([("x", k, "ABCDEF"[k % 3 :] + "-" * (k % 3)) for k in range(30)], "aln string, key int, s string")
    got = [sorted(map(tuple, pairwise.pair_table(rows, "aln", "key", F.col("s"), tiles=t).collect())) for t in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 435
