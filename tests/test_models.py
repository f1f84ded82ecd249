import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import models

HMM = models.HiddenMarkov("AB", [0.6, 0.4], [[0.6, 0.3], [0.2, 0.7]], [0.1, 0.1], [[0.9, 0.1], [0.3, 0.7]])


def joint(seq, path):
    p = HMM.start[path[0]] * HMM.end[path[-1]]
    for a, b in zip(path, path[1:]):
        p *= HMM.move[a][b]
    return p * math.prod(HMM.emit[s]["AB".index(c)] for s, c in zip(path, seq))


def test_hidden_markov_against_all_paths(spark):
    for seq in ("A", "ABBA", "BBABAA"):
        every = {p: joint(seq, p) for p in itertools.product((0, 1), repeat=len(seq))}
        total = sum(every.values())
        assert abs(HMM.log_likelihood(seq) - math.log(total)) < 1e-9
        score, path = HMM.best_path(seq)
        assert abs(score - math.log(max(every.values()))) < 1e-9 and abs(every[tuple(path)] - max(every.values())) < 1e-15
        want = np.array([[sum(v for p, v in every.items() if p[k] == s) / total for s in (0, 1)] for k in range(len(seq))])
        assert np.allclose(HMM.posterior(seq), want)
    df = spark.createDataFrame([("ABBA",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(models.log_likelihood(F.col("s"), HMM), models.best_path(F.col("s"), HMM)).collect()]
    assert got[1] == (0.0, []) and got[2] == (None, None) and abs(got[0][0] - HMM.log_likelihood("ABBA")) < 1e-12


def slow_score(a, b, s, opening, extending):
    m, x, y = ([[0.0 if t == 0 else -math.inf] * (len(b) + 1) for _ in range(len(a) + 1)] for t in range(3))
    best = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = max(0.0, m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1]) + s[a[i - 1], b[j - 1]]
            x[i][j] = max(m[i - 1][j] + opening, x[i - 1][j] + extending)
            y[i][j] = max(m[i][j - 1] + opening, y[i][j - 1] + extending)
            best = max(best, m[i][j])
    return best


def test_local_score_against_a_loop():
    rng = random.Random(4)
    s = {(a, b): 3.0 if a == b else -2.0 for a in "ACGT" for b in "ACGT"}
    for _ in range(100):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(14))) for _ in range(2))
        assert abs(models.local_score(a, b, s, -4.0, -1.0) - slow_score(a, b, s, -4.0, -1.0)) < 1e-9


def test_shuffles_keep_what_they_promise(spark):
    rng = random.Random(8)
    for _ in range(100):
        s = "".join(rng.choice("ABC") for _ in range(rng.randrange(30)))
        t = models.shuffle_pairs(s, rng)
        assert Counter(zip(s, s[1:])) == Counter(zip(t, t[1:])) and s[:1] == t[:1] and s[-1:] == t[-1:]
    df = spark.createDataFrame([(1, "ABCDEFGH"), (2, None)], "k int, s string")
    one, two = (df.select(models.shuffled(F.col("s"), F.col("k"), seed=3).alias("t")).collect() for _ in range(2))
    assert one == two and sorted(one[0].t) == list("ABCDEFGH") and one[1].t is None


def test_batches_give_what_enumeration_gives():
    rng = random.Random(8)
    model = models.HiddenMarkov("AB", [0.6, 0.4], [[0.7, 0.2], [0.3, 0.5]], [0.1, 0.2], [[0.9, 0.1], [0.2, 0.8]])
    seqs = ["".join(rng.choice("ABx") for _ in range(rng.randrange(7))) for _ in range(60)] + ["A" * 3000, ""]
    logs, paths = model.log_likelihoods(seqs), model.best_paths(seqs)

    def chance(s, path):
        p = model.start[path[0]]
        for k, (c, x) in enumerate(zip(s, path)):
            p *= (model.move[path[k - 1]][x] if k else 1) * (model.emit[x]["AB".index(c)] if c in "AB" else 1)
        return p * model.end[path[-1]]

    for s, log, (best, path) in zip(seqs[:60], logs, paths):
        every = [chance(s, p) for p in itertools.product(range(2), repeat=len(s))] if s else [1]
        assert log == pytest.approx(math.log(sum(every))) and best == pytest.approx(math.log(max(every)))
        assert len(path) == len(s) and (not s or chance(s, path) == pytest.approx(max(every)))
    assert np.isfinite(logs[60]) and len(paths[60][1]) == 3000 and (logs[61], paths[61]) == (0, (0.0, []))
    assert models.HiddenMarkov("AB", [1], [[0.5]], [0.5], [[1, 0]]).log_likelihood("AB") == float("-inf")


def test_columns_of_models_keep_nulls(spark):
    model = models.HiddenMarkov("AB", [1.0], [[0.5]], [0.5], [[0.5, 0.5]])
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "AB")], "k int, s string")
    got = {r.k: (r.a, r.b) for r in rows.select("k", models.log_likelihood(F.col("s"), model).alias("a"), models.best_path(F.col("s"), model).alias("b")).collect()}
    assert got[0] == (None, None) and got[1] == (0.0, []) and got[2] == (pytest.approx(math.log(1 / 16)), [0, 0])
