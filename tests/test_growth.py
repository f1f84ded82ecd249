"""Steps whose memory, time or plan must hold for tables far larger than those of the other tests."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from strandframe.operators import alignment, annotation, columns, editing, generation, models, sequence, structure
from strandframe.sources import alignments


def stored(spark, folder, rows, schema):
    """A table whose size is known from its file, so that Spark would broadcast it."""
    path = f"{folder}/{len(list(folder.iterdir()))}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def table(spark, folder, rows, aln="x"):
    return alignment.residue_table(stored(spark, folder, [(aln, k, s) for k, s in rows], "aln string, key int, aseq string"), "aln", "key", F.col("aseq"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_columns_are_not_broadcast(spark, tmp_path):
    got = generation.shuffled_within_columns(table(spark, tmp_path, [(k, "ACGT"[k % 4] + "AC"[k % 2]) for k in range(40)]), seed=3)
    assert "Broadcast" not in plan(got)
    counts = {(r["col"], r["res"]): r["count"] for r in got.groupBy("col", "res").count().collect()}
    assert counts == {(1, c): 10 for c in "ACGT"} | {(2, c): 20 for c in "AC"} and got.select("key", "col").distinct().count() == 80


def test_pairs_of_shared_inserts_are_not_shuffled(spark, tmp_path):
    rows = [(1, "A-cgT-a"), (2, "AG--Tc-"), (3, "--t-Ta-"), (4, "A---T--"), (5, "AaagTgg"), (6, "A---T--")]
    held = "x...x.."
    mask = spark.createDataFrame([("x", i, c == "x") for i, c in enumerate(held, 1)], "aln string, col int, keep boolean")
    res = table(spark, tmp_path, rows)
    got = annotation.shared_inserts(res, annotation.numbered_places(mask), res.where("key < 5").select("aln", "key"))
    assert not re.search(r"keys=\[aln#\d+L?, a#\d+L?, b#", plan(got))  # as an aggregate by pairs would need

    def begins(s):
        return {lo: at for lo, hi in ((1, 4), (5, 7)) if (at := next((i for i in range(lo, hi) if s[i] != "-"), None)) is not None}

    want, starts = set(), {k: begins(s) for k, s in rows}
    for a in range(1, 5):
        for b in starts:
            if a != b:
                same, either = sum(starts[b].get(p) == i for p, i in starts[a].items()), len(starts[a].keys() | starts[b].keys())
                want.add(("x", a, b, same, either, same / either if either else 1.0))
    assert len(want) == 20 and sorted(map(tuple, got.collect())) == sorted(want)


def test_paired_columns_are_not_broadcast(spark, tmp_path):
    res = table(spark, tmp_path, [(1, "ACG"), (2, "A-G"), (3, "ATG"), (4, "-TC")])
    pairs = spark.createDataFrame([("x", 1, 2), ("x", 1, 3)], "aln string, i int, j int")
    got = structure.pair_counts(res, pairs)
    assert "Broadcast" not in plan(got)
    assert {tuple(r)[1:] for r in got.collect()} == {(1, 2, "A", "C", 1), (1, 2, "A", "T", 1), (1, 3, "A", "G", 3)}


def test_shared_residues_are_not_broadcast(spark, tmp_path):
    a, b = table(spark, tmp_path, [(1, "AC-G"), (2, "ACTG"), (3, "----"), (4, "AC--")]), table(spark, tmp_path, [(1, "-ACG-"), (2, "-ACTG"), (3, "A----"), (4, "--A--")])
    got = columns.shared_residues(a, b)
    assert "Join" not in plan(got)
    assert {tuple(r)[1:] for r in got.collect()} == {(1, 2, 2), (2, 3, 2), (4, 4, 1), (3, 4, 1), (4, 5, 1), (1, 3, 1)}


def test_accuracy_is_not_broadcast(spark, tmp_path):
    schema = "key int, aseq string, reference string"
    known = stored(spark, tmp_path, [(1, "AC-G", "xxxx"), (2, "----", "xxxx"), (3, "ACGT", "x..x")], schema)
    test = stored(spark, tmp_path, [(1, "A-CG", "xxxx"), (2, "----", "xxxx"), (3, "ACGT", "x.x.")], schema)
    got = editing.accuracy(known, test)
    assert "Broadcast" not in plan(got)
    assert {tuple(r)[:3] for r in got.collect()} == {(1, 3, 2), (3, 4, 2)}


def test_marks_of_many_rows_are_rendered_in_one_pass():
    rows = [(f"r{k}", "AC-G") for k in range(20000)]
    notes = [("GR", n, "PP", "99.9") for n, _ in rows] + [("GC", None, "RF", "xxxx"), ("GR", "r7", "SS", "<..>"), ("GR", "unknown", "SS", "....")]
    began = time.process_time()
    lines = alignments.render_annotated(rows, notes).split("\n")
    assert time.process_time() - began < 5
    at = next(k for k, x in enumerate(lines) if x.startswith("r7 "))
    assert [x.split()[0] for x in lines[at : at + 4]] == ["r7", "#=GR", "#=GR", "r8"] and lines[at + 2].split()[1:] == ["r7", "SS", "<..>"]
    assert sum(x.startswith("#=GR") for x in lines) == 20001


def test_expected_counts_of_a_batch():
    m = models.HiddenMarkov("vc", [0.5, 0.5], [[0.4, 0.5], [0.5, 0.4]], [0.1, 0.1], [[0.6, 0.4], [0.3, 0.7]])
    seqs = ["vcvvc", "", "c", "v?cc", "vvvvvvvvccc", "vc"]
    for model, can in ((m, seqs), (models.HiddenMarkov("vc", [1.0, 0.0], m.move, m.end, [[1.0, 0.0], [0.3, 0.7]]), [s for s in seqs if not s.startswith("c")])):
        want = [sum(x) for x in zip(*(model.expected_counts(s) for s in can if s))]
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(model.summed_counts(seqs), want, strict=True))


def test_frames_of_a_batch(spark):
    texts = {1: "ATGAGATAAC", 2: "", 3: None, 4: "AC", 5: "ATGNNACGéTAA", 6: "TTT"}
    df = spark.createDataFrame(list(texts.items()), "k int, s string").coalesce(1)
    got = sequence.translate_frames(df, F.col("s"), "k", code=2)
    assert "ArrowEvalPython" not in plan(got)  # no array of frames per text
    read = sequence._reader(2)
    strand = {r["k"]: r["t"] for r in df.select("k", sequence.symbols.reverse_complement(F.col("s")).alias("t")).collect()}
    want = {(k, w, f, read(t, f)[0]) for w, of in ((1, texts), (-1, strand)) for k, t in of.items() if t is not None for f in range(3)}
    assert set(map(tuple, got.collect())) == want and len(want) == 30


def test_compared_structures_are_not_broadcast(spark, tmp_path):
    pairs = [stored(spark, tmp_path, rows, "k int, i int, j int") for rows in ([(1, 1, 6), (1, 2, 5), (2, 1, 5)], [(1, 2, 5), (3, 1, 4)])]
    got = structure.compare(*pairs, "k")
    assert "Broadcast" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, 1, 1, 0.5, 1.0), (2, 1, 0, 0, 0, 0.0, 0.0), (3, 0, 1, 0, 0, 0.0, 0.0)}
