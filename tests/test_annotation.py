"""Reference-line operators, scores, column maps, reports, and the fits and training added with them."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import distributions
from strandframe.operators import alignment, annotation, columns, fits, models, scoring
from strandframe.sources import reports


def table(spark, rows, aln="x"):
    df = spark.createDataFrame([(aln, k, s) for k, s in rows], "aln string, key int, aseq string")
    return alignment.residue_table(df, "aln", "key", F.col("aseq"))


def places(spark, reference, aln="x"):
    mask = spark.createDataFrame([(aln, i, c != ".") for i, c in enumerate(reference, 1)], "aln string, col int, keep boolean")
    return annotation.numbered_places(mask)


def test_inserts(spark):
    res, at = table(spark, [(1, "A-cgT"), (2, "AG--T"), (3, "--t-T")]), places(spark, "xx..x")
    got = annotation.insert_stats(res, at).collect()
    assert [(r["place"], r["n_rows"], round(r["share"], 4), r["mean_length"]) for r in got] == [(2, 2, 0.6667, 1.5)]
    assert [r["key"] for r in annotation.by_insert(res, at, 2, 2).collect()] == [1]
    moved = annotation.flush_left(table(spark, [(1, "A-.gT")]), at).orderBy("col").collect()
    assert "".join(r["res"] for r in moved) == "A-g.T"


def test_coverage(spark):
    got = annotation.coverage(table(spark, [(1, "A-C"), (2, "-GC"), (3, "---")]), places(spark, "xxx")).orderBy("place").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 2, 1, 0), (1, 2, 2, 1), (2, 1, 2, 0)]


def test_posterior_and_trim(spark):
    df = spark.createDataFrame([("AC-GT", "*5.09", "CG"), ("AAAA", "0000", "T"), ("", "", "A")], "s string, p string, part string")
    got = df.select(annotation.masked_by_posterior(F.col("s"), F.col("p"), 0.45).alias("m"), annotation.trimmed(F.col("s"), F.col("part")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("AC--T", "-C-G-"), ("----", None), ("", None)]


def test_scale_of_scores():
    s = np.where(np.eye(4, dtype=bool), 5.0, -4.0)
    p = [0.25] * 4
    lam = scoring.scale(s, p)
    assert math.isclose(sum(0.0625 * math.exp(lam * v) for v in s.ravel()), 1, rel_tol=1e-9)
    again, q = scoring.implied_background(s)
    assert math.isclose(again, lam, rel_tol=1e-6) and np.allclose(q, p)
    assert scoring.relative_entropy(s, p) > 0
    with pytest.raises(ValueError):
        scoring.scale(-s, p)


def test_expected_score(spark):
    cells = spark.createDataFrame([("A", "A", 2.0), ("A", "B", -1.0), ("B", "A", -1.0), ("B", "B", 3.0)], "a string, b string, score double")
    background = spark.createDataFrame([("A", 0.25), ("B", 0.75)], "s string, p double")
    assert math.isclose(scoring.expected_score(cells, background).first()[0], 2 / 16 - 2 * 3 / 16 + 3 * 9 / 16)


def test_best_chain_is_best():
    rng = random.Random(5)
    for _ in range(60):
        cells = list({(rng.randint(1, 5), rng.randint(1, 5)): rng.randint(1, 9) for _ in range(7)}.items())
        cells = [(i, j, n) for (i, j), n in cells]
        rising = lambda c: all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))
        want = max(sum(n for *_, n in c) for k in range(len(cells) + 1) for c in itertools.combinations(sorted(cells), k) if rising(c))
        got = columns.best_chain(cells)
        assert rising(got) and sum(n for *_, n in got) == want
    assert columns.best_chain([]) == []


def test_column_map(spark):
    got = columns.column_map(table(spark, [(1, "AC-G"), (2, "ACTG")]), table(spark, [(1, "-ACG-"), (2, "-ACTG")])).orderBy("i").collect()
    assert [(r["i"], r["j"], r["n"]) for r in got][:2] == [(1, 2, 2), (2, 3, 2)] and sum(r["n"] for r in got) == 6


#: Fixed values of the formats: the headings that the readers look for.
BLAST_LIST = "Sequences producing significant alignments:"
PROFILE_LIST = "Scores for complete sequences (score includes all domains):"
FASTA_LIST = "The best scores are:"


def blast_text(queries):
    """A pairwise report of invented targets: {query: [(target, description, [(bits, E, identical, of, query rows, target rows)])]}."""
    out = ["BLASTP"]
    for query, targets in queries.items():
        out += ["", f"Query= {query} made up", "         (40 letters)", ""]
        if not targets:
            out += [" ***** No hits found ******", "", "BLASTP"]
            continue
        out += [f"{BLAST_LIST}  (bits) Value", "", *[f"{t} {d}   {round(parts[0][0])}   {parts[0][1]}" for t, d, parts in targets], ""]
        for target, description, parts in targets:
            out += [f">{target} {description}", "          Length = 77", ""]
            for bits, e, same, of, *rows in parts:
                out += [f" Score = {bits} bits (9), Expect = {e},   Method: none.", f" Identities = {same}/{of} ({100 * same // of}%), Positives = {of}/{of} (100%)", ""]
                for (qs, q, qe), (ts, t, te) in zip(*rows):
                    out += [f"Query: {qs}   {q} {qe}", "          ", f"Sbjct: {ts}  {t} {te}", ""]
    return "\n".join(out)


BLAST = blast_text({
    "alpha": [
        ("ocean", "salt water", [(51.5, "e-33", 6, 8, [(3, "MKTW", 6), (7, "PLRV", 10)], [(21, "MKSW", 24), (25, "PIRV", 28)]), (17.0, "0.5", 3, 4, [(30, "GGHN", 33)], [(60, "GGHD", 63)])]),
        ("river", "sweet", [(23, "6.25", 5, 5, [(12, "QERTY", 16)], [(44, "QERTY", 48)])]),
    ],
    "beta": [],
})


def profile_text(query, length, listed, domains):
    """A profile report: listed (target, E, bits, words), a mark for the threshold where None stands, domains by target."""
    out = ["# made up", f"Query:       {query}  [L={length}]", PROFILE_LIST, "   first heading", "   second heading", "   -----"]
    out += ["  ------ inclusion threshold ------" if x is None else f"  {x[1]}  {x[2]}  0.3  {x[1]}  {x[2]}  0.2  1.1  1  {x[0]}  {x[3]}" for x in listed]
    out += ["", "", "Domain annotation for each sequence (and alignments):"]
    for target, rows in domains.items():
        out += [f">> {target}  said of it", "   heading", "   -----"]
        out += [f"   {k} !  {bits}  0.2  {e}  {e}  {q0}  {q1} ..  {t0}  {t1} ..  {t0}  {t1 + 2} .. 0.87" for k, (bits, e, q0, q1, t0, t1) in enumerate(rows, 1)]
        out.append("")
    return "\n".join([*out, "//", ""])


PROFILE = profile_text("lamp", 90, [("desk", "3e-20", 66.5, "of wood"), None, ("chair", "0.75", 8.25, "of straw")], {"desk": [(44.0, "2e-12", 5, 40, 11, 47), (22.5, "8e-06", 51, 88, 60, 99)]})


def fasta_text(query, hits):
    """A report of best scores: (target, words, length, raw, bits, E, identity, q0, q1, t0, t1)."""
    out = ["# made up", f"  1>>>{query} something - 64 aa", "Library: none", "", f"{FASTA_LIST}   bits E(1000)"]
    out += [f"{t} {words}   ( {n}) {raw} {bits} {e}" for t, words, n, raw, bits, e, *_ in hits]
    for t, words, n, raw, bits, e, same, q0, q1, t0, t1 in hits:
        out += ["", f">>{t} {words}  ({n} aa)", f" opt: {raw}  bits: {bits} E(1000): {e}", f"Score: {raw}; {same}% identity (90.0% similar) in {q1 - q0 + 1} aa overlap ({q0}-{q1}:{t0}-{t1})"]
    return "\n".join([*out, ""])


FASTA = fasta_text("north", [("hill", "green and steep", 230, 512, 81.75, "6.5e-15", 48.6, 4, 60, 101, 157), ("dale", "wide", 99, 40, 12.5, "3.2", 33.3, 20, 49, 8, 37)])


def saved(tmp_path, text):
    path = tmp_path / "report"
    path.write_text(text)
    return str(path)


def test_blast_report(spark, tmp_path):
    path = saved(tmp_path, BLAST)
    found = reports.blast_alignments(spark, path)
    assert sorted(map(tuple, found.collect())) == [
        ("alpha", "ocean", "salt water", 17.0, 0.5, 75.0, 30, 33, 60, 63),
        ("alpha", "ocean", "salt water", 51.5, 1e-33, 75.0, 3, 10, 21, 28),
        ("alpha", "river", "sweet", 23.0, 6.25, 100.0, 12, 16, 44, 48),
    ]
    assert sorted(map(tuple, reports.ranked_targets(spark, path, "blast").collect())) == [("alpha", "ocean", 52.0, 1e-33), ("alpha", "river", 23.0, 6.25)]
    lines = sorted(r[0] for r in reports.to_lines(reports.filtered(found, most_evalue=1.0, least_length=4), "tbl").collect())
    assert lines == ["0.5\t75\t30\t33\talpha\t60\t63\tocean\tsalt water", "1.0E-33\t75\t3\t10\talpha\t21\t28\tocean\tsalt water"]


def test_profile_report(spark, tmp_path):
    path = saved(tmp_path, PROFILE)
    assert sorted(map(tuple, reports.profile_alignments(spark, path).collect())) == [("lamp", "desk", "", 22.5, 8e-06, 0.0, 51, 88, 60, 99), ("lamp", "desk", "", 44.0, 2e-12, 0.0, 5, 40, 11, 47)]
    assert sorted(map(tuple, reports.ranked_targets(spark, path, "profile").collect())) == [("lamp", "chair", 8.25, 0.75), ("lamp", "desk", 66.5, 3e-20)]


def test_fasta_report(spark, tmp_path):
    path = saved(tmp_path, FASTA)
    assert sorted(map(tuple, reports.fasta_alignments(spark, path).collect())) == [("north", "dale", "wide", 12.5, 3.2, 33.0, 20, 49, 8, 37), ("north", "hill", "green and steep", 81.75, 6.5e-15, 48.0, 4, 60, 101, 157)]
    ranked = reports.ranked_targets(spark, path, "fasta")
    assert sorted(map(tuple, ranked.collect())) == [("north", "dale", 12.5, 3.2), ("north", "hill", 81.75, 6.5e-15)]
    assert reports.to_lines(ranked, "profmark").where("value LIKE '%dale%'").first()[0] == "3.2\t12.5\tdale\tnorth"


def test_fits_find_their_parameters(spark):
    rng = np.random.default_rng(3)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "x double")
    gumbel = -np.log(-np.log(rng.random(20000))) / 0.5 + 10
    mu, lam = fits.fit_gumbel_truncated(frame(gumbel), "x", 9.0)
    assert abs(mu - 10) < 0.3 and abs(lam - 0.5) < 0.03
    mu, lam, alpha = fits.fit_gev(frame(((-np.log(rng.random(20000))) ** -0.2 - 1) / 0.2 / 0.5 + 10), "x")
    assert abs(mu - 10) < 0.1 and abs(lam - 0.5) < 0.02 and abs(alpha - 0.2) < 0.03
    lam, tau = fits.fit_stretched(frame(rng.gamma(1 / 2.0, size=20000) ** 0.5 / 3), "x")
    assert abs(lam - 3) < 0.1 and abs(tau - 2) < 0.1
    slow = rng.random(20000) < 0.3
    parts = fits.fit_hyperexponential(frame(np.where(slow, rng.exponential(10, 20000), rng.exponential(0.2, 20000))), "x")
    assert abs(parts[0][0] - 0.3) < 0.03 and abs(parts[0][1] - 0.1) < 0.01 and abs(parts[1][1] - 5) < 0.4
    location = fits.gumbel_locations(frame(gumbel).withColumn("g", F.lit(1)), "x", 0.5, ["g"]).first()["mu"]
    assert abs(location - 10) < 0.05


def test_training_climbs(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("aaab") for _ in range(12)) + "".join(rng.choice("abbb") for _ in range(12))
    df = spark.createDataFrame([(text(),) for _ in range(80)] + [(None,), ("",)], "s string")
    start = models.HiddenMarkov("ab", [0.6, 0.4], [[0.6, 0.3], [0.3, 0.6]], [0.1, 0.1], [[0.6, 0.4], [0.4, 0.6]])
    model, history = models.train(df, "s", start, rounds=12, floor=0.0)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:])) and history[-1] > history[0]
    assert all(abs(sum(row) + end - 1) < 1e-9 for row, end in zip(model.move, model.end)) and np.allclose(np.sum(model.emit, axis=1), 1)


def test_expected_counts_by_listing_paths():
    m = models.HiddenMarkov("ab", [0.7, 0.3], [[0.5, 0.4], [0.2, 0.6]], [0.1, 0.2], [[0.9, 0.1], [0.3, 0.7]])
    seq, total, moves = "abb", 0.0, np.zeros((2, 2))
    for path in itertools.product(range(2), repeat=3):
        p = m.start[path[0]] * m.end[path[-1]]
        for s, c in zip(path, seq):
            p *= m.emit[s]["ab".index(c)]
        for s, t in zip(path, path[1:]):
            p *= m.move[s][t]
        total += p
        for s, t in zip(path, path[1:]):
            moves[s, t] += p
    got = m.expected_counts(seq)
    assert math.isclose(got[0][0], math.log(total)) and np.allclose(got[2], moves / total)


def test_mixture_posterior(spark):
    df = spark.createDataFrame([([3.0, 1.0],), ([0.0, 0.0],), (None,)], "c array<double>")
    one = [r[0] for r in df.select(distributions.mixture_posterior(F.col("c"), [(1.0, [1.0, 1.0])])).collect()]
    assert np.allclose(one[0], [4 / 6, 2 / 6]) and np.allclose(one[1], [0.5, 0.5]) and one[2] is None
    two = df.select(distributions.mixture_posterior(F.col("c"), [(0.5, [9.0, 1.0]), (0.5, [1.0, 9.0])])).first()[0]
    assert two[0] > two[1] and math.isclose(sum(two), 1)
