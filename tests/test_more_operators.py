import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import codecs, distributions
from strandframe.operators import alignment, editing, fits, splitting, structure, trees
from strandframe.streaming import events


def test_brackets_round_trip():
    for s in ("<<..>>", "<<AA>>aa", "(<[{}]>)", "......"):
        pairs = structure.bracket_pairs(s)
        assert structure.bracket_pairs(structure.pairs_to_brackets(pairs, len(s))) == pairs
    for bad in ("<<.>", ">", "<)", "A.b"):
        with pytest.raises(ValueError):
            structure.bracket_pairs(bad)


def test_structure_comparison(spark):
    df = spark.createDataFrame([(1, "<<..>>", ".<..>."), (2, "<...>.", ".<...>")], "k int, s string, t string")
    known, test = structure.pair_table(df, "k", "s"), structure.pair_table(df, "k", "t")
    got = {r.k: (r.n_known, r.n_predicted, r.found, r.right, r.sensitivity, r.ppv) for r in structure.compare(known, test, "k").collect()}
    assert got == {1: (2, 1, 1, 1, 0.5, 1.0), 2: (1, 1, 0, 0, 0.0, 0.0)}
    shifted = spark.createDataFrame([(1, 3, 9)], "k int, i int, j int")
    assert structure.compare(spark.createDataFrame([(1, 3, 10)], "k int, i int, j int"), shifted, "k", relaxed=True).first().sensitivity == 1.0


def test_mutual_information_of_bound_columns(spark):
    df = spark.createDataFrame([(1, k, a + b) for k, (a, b) in enumerate(["AU", "UA", "GC", "CG"])], "aln int, key int, s string")
    res = alignment.residue_table(df, "aln", "key", F.col("s"))
    pairs = spark.createDataFrame([(1, 1, 2)], "aln int, i int, j int")
    assert abs(structure.mutual_information(structure.pair_counts(res, pairs)).first().mi - 2) < 1e-9


def test_trees():
    d = np.array([[0, 2, 6, 10], [2, 0, 6, 10], [6, 6, 0, 10], [10, 10, 10, 0]], float)
    assert trees.cluster(d) == [(0, 1, 1.0), (2, 4, 3.0), (3, 5, 5.0)]
    assert trees.cluster(d, "single")[-1][2] == trees.cluster(d, "complete")[-1][2] == 10
    text = trees.to_newick("abcd", trees.cluster(d))
    nodes = trees.parse_newick(text)
    assert {n[2] for n in nodes if n[2]} == set("abcd") and len(nodes) == 7
    assert abs(sum(trees.tree_weights(trees.cluster(d), 4)) - 4) < 1e-9
    for bad in ("(a,b", "a,b;", "(a,b)"):
        with pytest.raises(ValueError):
            trees.parse_newick(bad)


def test_tree_weights_of_equal_rows(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["AAAAA", "AAAAA", "CCCCC", "CCCCC", "TTTTT"])], "aln int, key int, s string")
    got = [r.weight for r in trees.weights(df, "aln", "key", F.col("s")).orderBy("key").collect()]
    assert got[0] == pytest.approx(got[1]) and got[4] == pytest.approx(2 * got[0]) and sum(got) == pytest.approx(5)


def test_sets_without_links(spark):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i,) for i in range(80)], "node long")
    links = spark.createDataFrame([(rng.randrange(80), rng.randrange(80)) for _ in range(150)], "a long, b long")
    chosen = splitting.independent_set(nodes, links)
    assert splitting.broken_links(chosen, links, within=True).isEmpty()
    inside = {r.node for r in chosen.collect()}
    near = {x for r in links.collect() for x, y in ((r.a, r.b), (r.b, r.a)) if y in inside and x != y}
    assert inside | near == set(range(80))  # maximal
    sides = splitting.two_sets(nodes, links)
    assert splitting.broken_links(sides.where("side IS NOT NULL"), links, within=False).isEmpty() and sides.count() == 80


def test_matching_is_as_large_as_brute_force():
    rng = random.Random(5)

    def best(left, near, used=frozenset()):
        return 0 if left < 0 else max([best(left - 1, near, used)] + [1 + best(left - 1, near, used | {b}) for a, b in near if a == left and b not in used])

    for _ in range(60):
        links = list({(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(12))})
        got = splitting.matching(5, links)
        assert len(got) == best(4, links) == len(set(got.values())) and set(got.items()) <= set(links)


def test_row_filters(spark):
    df = spark.createDataFrame([(1, "AC--"), (1, "ACGT"), (1, "A---"), (1, "ACNN")], "g int, s string")
    keep = lambda d: sorted(r.s for r in d.collect())
    assert keep(editing.by_length(df, "s", least=2, most=3)) == ["AC--"]
    assert keep(editing.by_median_length(df, "s", "g", low=1.0)) == ["ACGT", "ACNN"]  # upper median 4
    assert keep(editing.by_ambiguity(df, "s", most=1)) == ["A---", "AC--", "ACGT"]
    assert keep(df.where(editing.truncated(df, "s", 3))) == ["A---"]
    names = spark.createDataFrame([("AC--",), ("zz",)], "n string")
    assert keep(editing.by_names(df, names, "s", keep=False)) == ["A---", "ACGT", "ACNN"]
    assert editing.missing_names(df, names, "s").first().s == "zz"


def test_columns_and_merge(spark):
    df = spark.createDataFrame([(1, 1, "A-C-"), (1, 2, "AG--")], "aln int, key int, s string")
    res = alignment.residue_table(df, "aln", "key", F.col("s"))
    got = editing.rows_from_residues(editing.by_columns(res, editing.gap_mask(res))).orderBy("key").collect()
    assert [r.aseq for r in got] == ["A-C", "AG-"]
    rows = spark.createDataFrame([(1, 1, "AaC", "x.x"), (2, 1, "GT", "xx"), (2, 2, "GA", "xx")], "aln int, key int, aseq string, reference string")
    got = {(r.aln, r.key): r.aseq for r in editing.merged(rows).collect()}
    assert got == {(1, 1): "AaC", (2, 1): "G.T", (2, 2): "G.A"}
    known = spark.createDataFrame([(1, "AC-G", "xxxx")], "key int, aseq string, reference string")
    test = spark.createDataFrame([(1, "A-CG", "xxxx")], "key int, aseq string, reference string")
    assert editing.accuracy(known, test).first().right == 2


def test_fetch_ranges(spark):
    table = spark.createDataFrame([("s", "AACGT")], "name string, seq string")
    req = spark.createDataFrame([("a", 2, 3, "s"), ("b", 3, 2, "s"), ("c", 4, 0, "s")], "newname string, start int, end int, source string")
    got = {r.newname: r.subseq for r in editing.fetch_ranges(req, table, source="name", seq="seq").collect()}
    assert got == {"a": "AC", "b": "GT", "c": "GT"}


def test_distributions_agree_with_their_inverses(spark):
    p = spark.createDataFrame([(k / 20,) for k in range(1, 20)], "p double")
    pairs = [
        (distributions.exponential_inverse, distributions.exponential_cdf, (1.0, 0.5)),
        (distributions.gumbel_inverse, distributions.gumbel_cdf, (-2.0, 0.7)),
        (distributions.gev_inverse, distributions.gev_cdf, (-2.0, 0.7, 0.3)),
        (distributions.gev_inverse, distributions.gev_cdf, (-2.0, 0.7, -0.3)),
        (distributions.weibull_inverse, distributions.weibull_cdf, (1.0, 0.5, 1.7)),
    ]
    for inverse, cdf, par in pairs:
        for r in p.select("p", cdf(inverse(F.col("p"), *par), *par).alias("q")).collect():
            assert abs(r.p - r.q) < 1e-9


def test_special_functions(spark):
    assert abs(distributions.digamma(1) + 0.5772156649015329) < 1e-12
    assert abs(distributions.trigamma(1) - math.pi**2 / 6) < 1e-11
    x = np.array([0.0, 0.3, 2.0, 40.0])
    assert np.allclose(distributions.incomplete_gamma(1.0, x), 1 - np.exp(-x), atol=1e-13)
    assert abs(distributions.chi_squared_survival(3.841458820694124, 1) - 0.05) < 1e-10
    df = spark.createDataFrame([(0.0,), (None,)], "x double")
    assert [r[0] for r in df.select(distributions.normal_cdf(F.col("x"), 0, 1)).collect()] == [0.5, None]


def test_fits_find_the_parameters(spark):
    rng = random.Random(9)
    gamma = spark.createDataFrame([(rng.gammavariate(2.5, 1 / 0.4),) for _ in range(20000)], "x double")
    lam, tau = fits.fit_gamma(gamma, "x")
    assert abs(lam - 0.4) < 0.02 and abs(tau - 2.5) < 0.1
    weibull = spark.createDataFrame([(rng.weibullvariate(2.0, 1.5),) for _ in range(20000)], "x double")
    lam, tau = fits.fit_weibull(weibull, "x")
    assert abs(lam - 0.5) < 0.02 and abs(tau - 1.5) < 0.05
    xs = [20 - math.log(-math.log(rng.random())) / 0.4 for _ in range(20000)]
    mu, lam = fits.fit_gumbel_censored(spark.createDataFrame([(x,) for x in xs if x >= 20], "x double"), "x", 20.0, sum(x < 20 for x in xs))
    assert abs(mu - 20) < 0.1 and abs(lam - 0.4) < 0.02


def test_codes(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 40)], "n int").select("n", codecs.elias_gamma(F.col("n")).alias("g"), codecs.elias_delta(F.col("n")).alias("d"), codecs.golomb_rice(F.col("n"), 2).alias("r"))
    rows = df.orderBy("n").collect()
    assert codecs.decode_elias_gamma("".join(r.g for r in rows)) == list(range(1, 40))
    assert rows[9].d == "00100010" and rows[9].r == "11010"
    table = codecs.huffman_table({"a": 5, "b": 2, "c": 1, "d": 1})
    bits = spark.createDataFrame([("abacad",), ("x",)], "t string").select(codecs.huffman_encode(F.col("t"), table)).collect()
    assert codecs.huffman_decode(bits[0][0], table) == "abacad" and bits[1][0] is None


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab" if i % 2 else "b") for i in range(100)], "id long, s string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = events.run_to_end(events.composition(stream, "s", []), str(tmp_path / "out"), checkpoint=str(tmp_path / "c1"))
    assert {(r.res, r.n) for r in got.collect()} == {("A", 50), ("B", 100)}
    write = events.reservoir_writer(str(tmp_path / "r"), 10, "id", seed=1)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    want = {r.id for r in df.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(10).collect()}
    assert {r.id for r in spark.read.parquet(str(tmp_path / "r/3")).collect()} == want


def test_clustering_takes_the_least_pair_of_nodes():
    def plain(d, linkage):
        groups, near, out = {k: [k] for k in range(len(d))}, {(a, b): d[a, b] for a in range(len(d)) for b in range(a + 1, len(d))}, []
        while len(groups) > 1:
            a, b = min(near, key=lambda p: (near[p], p))
            new = len(d) + len(out)
            out.append((a, b, near[a, b] / 2 if linkage in ("average", "weighted") else near[a, b]))
            for c in groups:
                if c not in (a, b):
                    x, y = near[min(a, c), max(a, c)], near[min(b, c), max(b, c)]
                    p, q = len(groups[a]), len(groups[b])
                    near[c, new] = {"average": (x * p + y * q) / (p + q), "weighted": (x + y) / 2, "single": min(x, y), "complete": max(x, y)}[linkage]
            groups[new] = groups.pop(a) + groups.pop(b)
            near = {p: v for p, v in near.items() if not {a, b} & set(p)}
        return out

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 14):
        for linkage in trees.LINKAGES:
            d = rng.integers(1, 6, (n, n)).astype(float)  # many ties
            d = np.triu(d, 1) + np.triu(d, 1).T
            assert trees.cluster(d, linkage) == [(a, b, pytest.approx(h)) for a, b, h in plain(d, linkage)]


def test_shapes_of_trees():
    assert trees.same_shape("((a:1,b:2):1,c:3);", "(c,(b,a));")
    assert not trees.same_shape("((a,b),c);", "((a,c),b);") and not trees.same_shape("(a,b);", "(a,c);")


def test_mixture_of_dirichlet_priors_is_found(spark):
    rng = np.random.default_rng(5)
    true = [(0.7, [8.0, 1.0, 1.0]), (0.3, [0.5, 4.0, 4.0])]
    rows = [(rng.multinomial(40, rng.dirichlet(true[int(rng.random() < 0.3)][1])).tolist(),) for _ in range(1500)] + [([0, 0, 0],), (None,)]
    found, history = fits.fit_dirichlet_mixture(spark.createDataFrame(rows, "c array<long>"), "c", 2, rounds=60)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:]))
    for (w, alpha), (want, prior) in zip(sorted(found, reverse=True), true):
        assert w == pytest.approx(want, abs=0.05) and np.array(alpha) / sum(alpha) == pytest.approx(np.array(prior) / sum(prior), abs=0.04)
    mean = sum(distributions.dirichlet_log_marginal(c, [1.0, 1.0, 1.0]) for c, in rows[:-2])
    assert history[-1] > mean  # better than one even prior
    with pytest.raises(ValueError):
        fits.fit_dirichlet_mixture(spark.createDataFrame([], "c array<long>"), "c", 2)


def test_rows_in_a_listed_order(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    order = spark.createDataFrame([("c", 1), ("a", 2), ("a", 9), ("x", 3), (None, 4)], "n string, at int")
    assert [r.name for r in editing.reordered(rows, order, "name").orderBy("place").collect()] == ["c", "a"]
    assert {(r.name, r.place) for r in editing.reordered(rows, order, "name", rest=True).collect()} == {("c", 1), ("a", 2), ("b", None)}


def test_alignments_divided_into_clusters(spark):
    rows = ["AAAAAAAA", "AAAAAAAC", "CCCCCCCC", "CCCCCCCA", "GGGGGGGG", "AAAAAACC"]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(rows)], "aln int, key int, s string")
    got = lambda n: [r.cluster for r in trees.partition(df, "aln", "key", F.col("s"), n).orderBy("key").collect()]
    assert got(3) == [0, 0, 1, 1, 2, 0] and got(1) == [0] * 6 and got(9) == [0, 1, 2, 3, 4, 5]
    sized = [r.cluster for r in trees.partition(df, "aln", "key", F.col("s"), size=3).orderBy("key").collect()]
    assert max(map(sized.count, sized)) >= 3
    merges = trees.cluster(trees.difference(rows), "single")
    sizes = lambda n: max(map(trees.cut(merges, 6, n).count, range(n)))
    assert all(trees.parts_with(merges, 6, k) == max([n for n in range(1, 7) if sizes(n) >= k], default=1) for k in range(1, 9))
    for n in range(1, 7):
        assert len(set(trees.cut(merges, 6, n))) == n
