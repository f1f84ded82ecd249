"""Random sequences, vectors, conversions, consistent pairs and annotated alignments."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandframe.functions import symbols, vectors
from strandframe.operators import generation, structure
from strandframe.sources import alignments


def test_independent_symbols(spark):
    df = generation.independent(spark, 50, 200, {"A": 1, "B": 3, "C": 0}, seed=3)
    rows = df.collect()
    counts = Counter("".join(r["seq"] for r in rows))
    assert {len(r["seq"]) for r in rows} == {200} and set(counts) == {"A", "B"} and abs(counts["B"] / 10000 - 0.75) < 0.02
    assert rows == df.repartition(7).sort("id").collect() and len({r["seq"] for r in rows}) == 50
    assert generation.independent(spark, 2, 0, {"A": 1}, seed=3).first()["seq"] == ""
    with pytest.raises(ValueError):
        generation.independent(spark, 1, 1, {"A": 0}, seed=1)


def test_chained_symbols(spark):
    text = "".join(r["seq"] + "|" for r in generation.chained(spark, 60, 100, {"A": 1}, {"A": {"B": 1}, "B": {"A": 1, "B": 3}}, seed=5).collect())
    pairs = Counter(zip(text, text[1:]))
    assert ("A", "A") not in pairs and abs(pairs["B", "A"] / (pairs["B", "A"] + pairs["B", "B"]) - 0.25) < 0.03
    assert all(part[0] == "A" for part in text.split("|") if part)


def test_choices_and_windows(spark):
    picked = Counter(r[0] for r in spark.range(4000).select(generation.choice({"x": 1, "y": 4}, seed=1, key=F.col("id"))).collect())
    assert abs(picked["y"] / 4000 - 0.8) < 0.03
    df = spark.createDataFrame([(1, "aaaabbbbccccdd"), (2, ""), (3, None)], "k int, s string")
    got = [r[0] for r in df.select(generation.shuffled_windows(F.col("s"), F.col("k"), 4, seed=9)).collect()]
    assert got == ["aaaabbbbccccdd", "", None]
    mixed = spark.createDataFrame([(1, "abcdefghij")], "k int, s string").select(generation.shuffled_windows(F.col("s"), F.col("k"), 5, seed=9)).first()[0]
    assert sorted(mixed[:5]) == list("abcde") and sorted(mixed[5:]) == list("fghij")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0], [2.0, 2.0]), ([], []), (None, None), ([0.0, 0.0], [1.0, 1.0])], "v array<double>, w array<double>")
    v, w = F.col("v"), F.col("w")
    cols = [vectors.dot(v, w), vectors.arg_max(v), vectors.normalised(v), vectors.cumulative(v), vectors.added(v, w, -1.0), vectors.scaled(v, 2.0), vectors.is_probability(vectors.normalised(v)), vectors.log_sum_exp(v)]
    rows = [tuple(r) for r in df.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()]
    assert rows[0][:7] == (8.0, 2, [0.25, 0.75], [1.0, 4.0], [-1.0, 1.0], [2.0, 6.0], True)
    assert rows[1] == (0.0, 0, [], [], [], [], False, float("-inf"))
    assert rows[2] == (None,) * 8
    assert rows[3][1:4] == (1, [0.5, 0.5], [0.0, 0.0])
    assert df.select(vectors.relative_entropy(vectors.normalised(v), F.array(F.lit(1.0), F.lit(0.0)))).first()[0] == float("inf")


def test_conversions(spark):
    df = spark.createDataFrame([("acU-x_R",)], "s string")
    s = F.col("s")
    got = df.select(symbols.converted(s, "dna", "no_degenerate", "no_x", gap="."), symbols.converted(s, "upper", "rna"), symbols.converted(s, replace=("ac", "z"))).first()
    assert tuple(got) == ("acT.n.N", "ACU-X_R", "zzU-x_R")
    assert spark.createDataFrame([("<<A..>>a",)], "s string").select(symbols.reversed_structure(F.col("s"))).first()[0] == "A<<..a>>"
    with pytest.raises(ValueError):
        symbols.converted(s, replace=("abc", "de"))


def test_consistent_pairs(spark):
    rows = spark.createDataFrame([("x", k) for k in range(4)], "aln string, key int")
    pairs = spark.createDataFrame([("x", 0, 1, 9), ("x", 1, 1, 9), ("x", 2, 1, 9), ("x", 3, 1, 8), ("x", 0, 2, 7)], "aln string, key int, i int, j int")
    support = structure.pair_support(pairs, rows)
    assert [tuple(r) for r in structure.conflicts(support).collect()] == [("x", 1, 2)]
    assert structure.least_share(support).first()["share"] == 0.25
    assert [(r["i"], r["j"]) for r in structure.consistent_pairs(support).collect()] == [(1, 9)]
    assert [(r["i"], r["j"]) for r in structure.consistent_pairs(support, 0.0).collect()] == [(2, 7)]
    assert structure.consistent_pairs(support.where("i = 2")).count() == 1


def test_annotated_alignment(spark):
    rows = spark.createDataFrame([("x", 0, "s1", "AC-G"), ("x", 1, "s2", "ACUG")], "aln string, seqidx int, name string, aseq string")
    notes = [("GF", None, "ID", "family"), ("GF", None, "CC", "one\ntwo"), ("GS", "s2", "AC", "K1"), ("GR", "s1", "PP", "99.*"), ("GC", None, "SS_cons", "<..>")]
    df = spark.createDataFrame([("x", *n) for n in notes] + [("y", *notes[0])], "aln string, kind string, name string, tag string, value string")
    found = alignments.to_annotated(rows, df).collect()
    assert len(found) == 1
    text = found[0]["value"]
    assert list(alignments.parse_stockholm(text)) == [[("s1", "AC-G"), ("s2", "ACUG")]]
    assert sorted(map(str, (n[1:] for n in alignments.stockholm_annotation(text)))) == sorted(map(str, notes))


def test_ranges_are_parsed(spark):
    texts = ["10..23", "39-91", "7..", "7", "", "a-b", "1..2..3", " 1-2", "99999999999999999999-1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(symbols.coordinates(F.col("t")).alias("c")).collect()
    assert [r.c and tuple(r.c) for r in rows] == [(10, 23), (39, 91), (7, 0), None, None, None, None, None, None, None]
