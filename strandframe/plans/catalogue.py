"""Registered queries on the driver's tables, each with the SQL that gives the same rows.

Doubles are rounded here, and only here, as sums of doubles depend on the order of the rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import codecs, distributions, draws, families, storage, symbols, vectors
from strandframe.operators import alignment, annotation, columns, editing, fits, generation, matrices, models, numeric, pairwise, scoring, sequence, splitting, structure, trees
from strandframe.sources import alignments, packed, reports, sequences
from strandframe.streaming import events as streams

NAME_WIDTH = 12
FRAME_LEAST = 20

_UP = f"translate({{0}}, '{symbols.LOWER}', '{symbols.UPPER}')"
_RES = f"regexp_replace({_UP}, '[^A-Z]', '', 'g')"
_ALN = f"rpad(regexp_replace({_UP}, '[^A-Z]', '-', 'g'), {{1}}, '-')"
_DNA = f"translate({_RES}, '{symbols.UPPER}', '{symbols.TO_DNA}')"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.residue_table(_t(spark, sf_dir, "part"), "p_brand", "p_partkey", symbols.aligned(F.col("p_name"), NAME_WIDTH))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").withColumn("aln", F.lit(1))


def _item_row(items: DataFrame) -> Column:
    """The items as rows of one alignment, as wide as the longest."""
    width = items.agg(F.max(F.length("text"))).first()[0] or 1
    return symbols.aligned(F.col("text"), width)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return pairwise.pair_table(items, "aln", "item_id", _item_row(items))


_NAMES_SQL = f"WITH a AS (SELECT p_brand AS aln, p_partkey AS key, {_ALN.format('p_name', NAME_WIDTH)} AS s FROM part), res AS (SELECT aln, key, i AS col, substr(s, i, 1) AS res FROM a, unnest(range(1, {NAME_WIDTH + 1})) u(i)) "
_WIDE = "(SELECT max(length(text))::INT FROM benchmark)"
_PAIRS_SQL = f"""WITH a AS (SELECT item_id AS k, {_ALN.format('text', _WIDE)} AS s, length({_RES.format('text')}) AS n FROM benchmark),
res AS (SELECT k, unnest(range(1, length(s) + 1)) AS col, unnest(string_split(s, '')) AS c FROM a),
pr AS (SELECT x.k AS i, y.k AS j, x.n AS len_i, y.n AS len_j FROM a x JOIN a y ON x.k < y.k),
cnt AS (SELECT x.k AS i, y.k AS j, count(*) FILTER (WHERE x.c = y.c AND x.c <> '-') AS n_id, count(*) FILTER (WHERE x.c <> '-' AND y.c <> '-') AS n_match,
  count(*) FILTER (WHERE x.c <> '-' OR y.c <> '-') AS n_any FROM res x JOIN res y ON x.col = y.col AND x.k < y.k GROUP BY 1, 2),
p AS (SELECT 1 AS aln, pr.i, pr.j, len_i, len_j, n_id, n_match, n_any, CASE WHEN least(len_i, len_j) > 0 THEN n_id / least(len_i, len_j)::DOUBLE ELSE 0.0 END AS pid,
  CASE WHEN n_any > 0 THEN n_match / n_any::DOUBLE ELSE 0.0 END AS pmatch FROM pr JOIN cnt USING (i, j)) """


@query("SELECT lang, count(*) AS nseq, sum(length(text))::BIGINT AS nres, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len, round(avg(length(text)), 6) AS mean_len FROM documents WHERE text IS NOT NULL GROUP BY lang")
def q01_sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(sequence.seq_stats(_t(spark, sf_dir, "documents"), "text", ["lang"]), 6, "mean_len")


@query(f"WITH r AS (SELECT lang, unnest(string_split({_RES.format('text')}, '')) AS res FROM documents), c AS (SELECT lang, res, count(*) AS n FROM r WHERE res <> '' GROUP BY ALL) SELECT lang, res, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS freq FROM c")
def q02_residue_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(sequence.residue_composition(_t(spark, sf_dir, "documents"), "text", ["lang"]), 6, "freq")


@query(f"SELECT doc_id, md5(reverse(translate({_DNA.format('text')}, 'ACGT', 'TGCA'))) AS revcomp_md5 FROM documents")
def q03_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(symbols.reverse_complement(symbols.as_dna(F.col("text"))).cast("binary")).alias("revcomp_md5"))


@query("SELECT p_partkey, concat(substr(p_name, 1, 2), regexp_replace(substr(p_name, 3, 4), '[A-Za-z]', 'X', 'g'), substr(p_name, 7)) AS masked, concat(regexp_replace(substr(p_name, 1, 2), '[A-Za-z]', 'X', 'g'), substr(p_name, 3, 4), regexp_replace(substr(p_name, 7), '[A-Za-z]', 'X', 'g')) AS kept FROM part")
def q04_mask_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", symbols.mask_range(n, 3, 6).alias("masked"), symbols.mask_range(n, 3, 6, invert=True).alias("kept"))


_COUNT = "(n - length(translate(s, '{0}', '')))"
_KINDS = " + ".join(f"(s LIKE '%{c}%')::INT" for c in "ACGDHKMRSVWYNT")
_GUESS = f"""SELECT doc_id, CASE WHEN n <= 10 THEN 'unknown' WHEN n > 2000 AND {_COUNT.format('N')} = n THEN 'dna' WHEN {_COUNT.format('EFIJLOPQZ')} > 0 THEN 'amino'
WHEN n - {_COUNT.format('ACGTN')} <= 0.02::DOUBLE * n AND s LIKE '%A%' AND s LIKE '%C%' AND s LIKE '%G%' AND s LIKE '%T%' THEN 'dna'
WHEN n - {_COUNT.format('ACGUN')} <= 0.02::DOUBLE * n AND s LIKE '%A%' AND s LIKE '%C%' AND s LIKE '%G%' AND s LIKE '%U%' THEN 'rna'
WHEN n - {_COUNT.format('ACGDHKMRSVWYNTX')} <= 0.02::DOUBLE * n AND {_COUNT.format('DHKMRSVWY')} > {_COUNT.format('ACG')} AND {_KINDS} >= 15 THEN 'amino' ELSE 'unknown' END AS alphabet, n::BIGINT AS n_letters
FROM (SELECT doc_id, s, length(s) AS n FROM (SELECT doc_id, {{0}} AS s FROM documents))"""


@query(_GUESS.format(_RES.format("text")))
def q05_guess_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.guess_alphabet(_t(spark, sf_dir, "documents"), "text", "doc_id")


@query(_GUESS.format(_DNA.format("text")))
def q05b_guess_alphabet_of_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.guess_alphabet(_t(spark, sf_dir, "documents").select("doc_id", symbols.as_dna(F.col("text")).alias("dna")), "dna", "doc_id")


_BINS = "(SELECT ceil(l_extendedprice / 5000.0::DOUBLE - 1)::BIGINT AS bin, count(*) AS obs FROM lineitem GROUP BY 1)"


def _price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 5000.0)


@query(f"SELECT bin, bin * 5000.0::DOUBLE AS lo, (bin + 1) * 5000.0::DOUBLE AS hi, obs FROM {_BINS}")
def q06_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_bins(spark, sf_dir)


@query(f"SELECT bin, bin * 5000.0::DOUBLE AS lo, round((sum(obs) OVER (ORDER BY bin DESC) / sum(obs) OVER ())::DOUBLE, 6) AS surv FROM {_BINS}")
def q07_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(numeric.survival(_price_bins(spark, sf_dir)), 6, "surv")


@query(f"WITH c AS (SELECT bin * 5000.0::DOUBLE AS lo, obs, sum(obs) OVER (ORDER BY bin DESC) AS cum, sum(obs) OVER () AS n FROM {_BINS}) SELECT min(lo) AS phi, sum(obs)::BIGINT AS n_tail, max(n)::BIGINT AS n_all FROM c WHERE cum - obs < 0.01 * n")
def q08_tail_by_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.tail_by_mass(_price_bins(spark, sf_dir), 0.01)


@query("SELECT min(o_totalprice) AS nth_value, count(*) AS n FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 100)")
def q09_nth_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.nth_highest(_t(spark, sf_dir, "orders"), "o_totalprice", 100)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE var_samp(value) END, 4) AS var FROM events GROUP BY 1")
def q10_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_r(numeric.moments(_t(spark, sf_dir, "events"), "value", ["event_type"]), 6, "mean"), 4, "var")


@query("SELECT l_returnflag, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS a, round(regr_slope(l_extendedprice, l_quantity), 3) AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def q11_linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_r(numeric.linear_regression(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 3, "a", "b"), 6, "r")


_X = "(CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END)"
_ONE = lambda k, n: f"({_X.format(k)} + {_X.format(f'({n} - {k})')} - {_X.format(n)})"
_LLR = f"({_ONE('k', 'n')} + {_ONE('k2', 'n2')} - {_ONE('(k + k2)', '(n + n2)')})"


@query(f"WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1), d AS (SELECT *, sum(k) OVER () - k AS k2, sum(n) OVER () - n AS n2 FROM c) SELECT o_orderpriority, k::BIGINT AS k, n::BIGINT AS n, round({_LLR}, 5) AS llr, round(2 * {_LLR}, 5) AS g2 FROM d")
def q12_g_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(numeric.g_test(_t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", "o_orderpriority"), 5, "llr", "g2")


@query("WITH c AS (SELECT l_linestatus, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), q AS (SELECT l_returnflag, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY 1), p AS (SELECT l_linestatus, l_returnflag, n / sum(n) OVER (PARTITION BY l_linestatus) AS p FROM c) SELECT l_linestatus, count(*) AS n_kinds, round(-sum(p * log2(p)), 6) AS entropy, round(sum(p * log2(p / q)), 6) AS rel_entropy, round(log2((SELECT count(*) FROM q)) + sum(p * log2(p)), 6) AS information FROM p JOIN q USING (l_returnflag) GROUP BY 1")
def q13_category_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(numeric.category_entropy(_t(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linestatus"]), 6, "entropy", "rel_entropy", "information")


@query(_NAMES_SQL + ", c AS (SELECT aln, col, res, count(*) AS n FROM res WHERE res <> '-' GROUP BY ALL), s AS (SELECT aln, col, res, 1.0::DOUBLE / (count(*) OVER (PARTITION BY aln, col) * n) AS share FROM c), w AS (SELECT r.aln, r.key, coalesce(sum(share), 0) / greatest(count(share), 1) AS raw FROM res r LEFT JOIN s USING (aln, col, res) GROUP BY ALL) SELECT aln, key, round(CASE WHEN sum(raw) OVER (PARTITION BY aln) > 0 THEN raw * count(*) OVER (PARTITION BY aln) / sum(raw) OVER (PARTITION BY aln) ELSE 1 END, 6) AS weight FROM w")
def q14_position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(alignment.position_weights(_names(spark, sf_dir)), 6, "weight")


@query(_NAMES_SQL + "SELECT aln, col::INT AS col, res, count(*) AS n FROM res WHERE res <> '-' GROUP BY ALL")
def q15_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.column_counts(_names(spark, sf_dir))


@query(_NAMES_SQL + ", c AS (SELECT aln, col, res, count(*) AS n FROM res WHERE res <> '-' GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY aln, col)::DOUBLE AS p FROM c), i AS (SELECT aln, col, sum(n)::BIGINT AS n_res, round(log2(26) + sum(p * log2(p)), 6) AS information FROM p GROUP BY aln, col) SELECT aln, col::INT AS col, coalesce(n_res, 0) AS n_res, coalesce(information, 0.0::DOUBLE) AS information FROM (SELECT DISTINCT aln, col FROM res) LEFT JOIN i USING (aln, col)")
def q16_column_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(alignment.column_information(_names(spark, sf_dir)), 6, "information")


@query(_NAMES_SQL + "SELECT aln, col::INT AS col, round(1 - count(*) FILTER (WHERE res = '-') / count(*)::DOUBLE, 6) AS occupied, count(*) FILTER (WHERE res = '-') / count(*)::DOUBLE <= 0.5 AS keep FROM res GROUP BY ALL")
def q17_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(alignment.occupancy(_names(spark, sf_dir)), 6, "occupied")


@query(_NAMES_SQL + ", c AS (SELECT aln, col, res, count(*) AS n FROM res GROUP BY ALL), t AS (SELECT aln, col, sum(n) AS tot, coalesce(sum(n) FILTER (WHERE res <> '-'), 0) AS nres FROM c GROUP BY ALL), b AS (SELECT aln, col, res FROM c WHERE res <> '-' QUALIFY row_number() OVER (PARTITION BY aln, col ORDER BY n DESC, res) = 1) SELECT aln, string_agg(CASE WHEN nres / tot::DOUBLE >= 0.5 THEN res ELSE '-' END, '' ORDER BY col) AS consensus FROM t LEFT JOIN b USING (aln, col) GROUP BY aln")
def q18_consensus_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.consensus_line(_names(spark, sf_dir))


@query(f"SELECT 1 AS aln, item_id AS key, length(rtrim(ltrim(s, '-'), '-'))::BIGINT AS span, length(rtrim(ltrim(s, '-'), '-')) < ceil(length(s) * 0.5) AS is_fragment FROM (SELECT item_id, {_ALN.format('text', _WIDE)} AS s FROM benchmark)")
def q19_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return alignment.fragments(items, "aln", "item_id", _item_row(items))


@query("SELECT doc_id, s::INT AS start, substr(text, greatest(1, s - 10), s + 50 - greatest(1, s - 10)) AS \"window\" FROM documents, unnest(range(1, length(text) + 1, 50)) u(s) WHERE length(text) > 0")
def q20_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.windows(_t(spark, sf_dir, "documents"), "text", "doc_id", context=10, width=50)


@query(f"WITH s AS (SELECT lang, {_RES.format('text')} AS s FROM documents) SELECT lang, substr(s, i, 3) AS kmer, count(*) AS n FROM s, unnest(range(1, length(s) - 1)) u(i) WHERE length(s) >= 3 GROUP BY ALL")
def q21_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.kmer_counts(_t(spark, sf_dir, "documents"), "text", ["lang"], 3)


@query(f"WITH s AS (SELECT lang, {_RES.format('text')} AS s FROM documents), k AS (SELECT lang, substr(s, i, 1) AS src, substr(s, i + 1, 1) AS dst, count(*) AS n FROM s, unnest(range(1, length(s))) u(i) WHERE length(s) >= 2 GROUP BY ALL) SELECT lang, src, dst, n, round(n / sum(n) OVER (PARTITION BY lang, src), 6) AS p FROM k")
def q21b_markov_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(sequence.markov_transitions(_t(spark, sf_dir, "documents"), "text", ["lang"]), 6, "p")


_STEP = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(((h + c) & 4294967295) + ((((h + c) & 4294967295) << 10) & 4294967295) & 4294967295, (((h + c) & 4294967295) + ((((h + c) & 4294967295) << 10) & 4294967295) & 4294967295) >> 6))"


@query(f"WITH a AS (SELECT p_partkey, {_STEP} AS h FROM part), b AS (SELECT p_partkey, (h + ((h << 3) & 4294967295)) & 4294967295 AS h FROM a), c AS (SELECT p_partkey, xor(h, h >> 11) AS h FROM b) SELECT p_partkey, (h + ((h << 15) & 4294967295)) & 4294967295 AS checksum FROM c")
def q22_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", symbols.jenkins_checksum(F.col("p_name")).alias("checksum"))


@query(f"SELECT p_partkey, {_RES.format('p_name')} AS letters, list_sum(list_transform(string_split({_RES.format('p_name')}, ''), lambda c: ascii(c) - 65))::BIGINT AS code_sum FROM part")
def q23_digitise_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = symbols.digitised(symbols.residues_only(F.col("p_name")))
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x)
    return _t(spark, sf_dir, "part").select("p_partkey", codes.alias("_c")).select("p_partkey", symbols.textised(F.col("_c")).alias("letters"), total.alias("code_sum"))


@query("SELECT part, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n_rows FROM (SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) AS part FROM documents) GROUP BY part")
def q24_even_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.even_ranges(_t(spark, sf_dir, "documents"), "doc_id", 7)


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY 1")
def q25_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@query(_PAIRS_SQL + "SELECT i, j, n_id, least(len_i, len_j)::INT AS denom, round(pid, 6) AS pid FROM p")
def q26_pairwise_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("i", "j", "n_id", F.least("len_i", "len_j").alias("denom"), F.round("pid", 6).alias("pid"))


@query(_PAIRS_SQL + "SELECT i, j, n_match, n_any, round(pmatch, 6) AS pmatch FROM p")
def q27_pairwise_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("i", "j", "n_match", "n_any", F.round("pmatch", 6).alias("pmatch"))


@query(_PAIRS_SQL + "SELECT aln, count(*) AS n_pairs, round(avg(pid), 6) AS mean_pid, round(avg(pmatch), 6) AS mean_pmatch, round(avg((pid > 0.1)::INT), 6) AS connectivity FROM p GROUP BY aln")
def q28_pairwise_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pairwise.averages(_pairs(spark, sf_dir), 0.1), 6, "mean_pid", "mean_pmatch", "connectivity")


@query(_PAIRS_SQL + ", x AS (SELECT i, j, n_match, 1 - (1 - n_id / nullif(n_match, 0)::DOUBLE) * 26 / 25 AS x FROM p) SELECT i, j, round(CASE WHEN x > 1e-12 THEN abs(-25 / 26.0::DOUBLE * ln(x)) END, 5) AS distance FROM x")
def q29_jukes_cantor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pairwise.jukes_cantor(_pairs(spark, sf_dir), 26), 5, "distance").drop("aln")


@query(_PAIRS_SQL + "SELECT aln, i, j, round(1 - pid, 6) AS d FROM p UNION ALL SELECT aln, j, i, round(1 - pid, 6) FROM p UNION ALL SELECT 1, k, k, 0.0 FROM a")
def q30_difference_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pairwise.difference_matrix(_pairs(spark, sf_dir), _items(spark, sf_dir), "aln", "item_id"), 6, "d")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.identity_clusters(_pairs(spark, sf_dir), _items(spark, sf_dir), "aln", "item_id", 0.12)


_CLUSTERS_SQL = _PAIRS_SQL.replace("WITH a AS", "WITH RECURSIVE a AS") + ", e AS (SELECT i, j FROM p WHERE pid >= 0.12 UNION SELECT j, i FROM p WHERE pid >= 0.12 UNION SELECT k, k FROM a), t AS (SELECT i, j FROM e UNION SELECT t.i, e.j FROM t JOIN e ON t.j = e.i), k AS (SELECT 1 AS aln, i AS key, min(j) AS cluster FROM t GROUP BY i) "


@query(_CLUSTERS_SQL + "SELECT * FROM k")
def q31_identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@query(_CLUSTERS_SQL + "SELECT aln, key, round(count(*) OVER () / (SELECT count(DISTINCT cluster) FROM k)::DOUBLE / count(*) OVER (PARTITION BY cluster), 6) AS weight FROM k")
def q32_cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pairwise.cluster_weights(_clusters(spark, sf_dir)), 6, "weight")


_GREEDY_SQL = _PAIRS_SQL.replace("WITH a AS", "WITH RECURSIVE a AS") + """, c AS (SELECT key, list(other) AS near FROM (SELECT i AS key, j AS other FROM p WHERE pid >= 0.12 UNION ALL SELECT j, i FROM p WHERE pid >= 0.12) GROUP BY key),
{0} o AS (SELECT k AS key, row_number() OVER (ORDER BY {1} k) AS pos, coalesce(near, []) AS near FROM a LEFT JOIN c ON c.key = a.k {2}),
f AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept UNION ALL SELECT o.pos, CASE WHEN list_has_any(kept, o.near) THEN kept ELSE list_append(kept, o.key) END FROM f JOIN o ON o.pos = f.pos + 1)
SELECT 1 AS aln, unnest(kept) AS key FROM f WHERE pos = (SELECT max(pos) FROM o)"""


@query(_GREEDY_SQL.format("", "", ""))
def q33_identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return pairwise.identity_filter(items, "aln", "item_id", _item_row(items), 0.12)


_COVER_SQL = "held AS (SELECT col, avg((c <> '-')::INT) >= 0.5 AS h FROM res GROUP BY col), ends AS (SELECT k, min(col) AS lo, max(col) AS hi FROM res WHERE c <> '-' GROUP BY k), cover AS (SELECT k AS ck, count(*) FILTER (WHERE h AND col BETWEEN lo AND hi) AS n FROM ends, held GROUP BY k),"


@query(_GREEDY_SQL.format(_COVER_SQL, "coalesce(cover.n, 0) DESC,", "LEFT JOIN cover ON ck = a.k"))
def q33b_identity_filter_by_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return pairwise.identity_filter(items, "aln", "item_id", _item_row(items), 0.12, prefer="span")


@query("SELECT event_type, min(value) AS mu, round(1 / (avg(value) - min(value)), 8) AS rate FROM events GROUP BY 1")
def q35_fit_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(numeric.fit_exponential(_t(spark, sf_dir, "events"), "value", ["event_type"]), 8, "rate")


@query("SELECT event_type, count(*) AS n, round(avg(ln(value)), 6) AS mu, round(stddev_samp(ln(value)), 6) AS sigma FROM events WHERE value > 0 GROUP BY 1")
def q36_fit_lognormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(numeric.fit_lognormal(_t(spark, sf_dir, "events"), "value", ["event_type"]), 6, "mu", "sigma")


def _bisected(cut: str, *, over: str = "", low: float, high: float, rounds: int = 80) -> str:
    """A table `b(k, lo, hi)` whose last row encloses the place `m` at which the falling expression `cut` is zero, by halving in the logarithm. `cut` may sum over the tables `over`."""
    groups = " GROUP BY k, lo, hi, m" if over else ""
    return f"b AS (SELECT 0 AS k, {low!r}::DOUBLE AS lo, {high!r}::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN f > 0 THEN m ELSE lo END, CASE WHEN f > 0 THEN hi ELSE m END FROM (SELECT k, lo, hi, m, {cut} AS f FROM (SELECT *, sqrt(lo * hi) AS m FROM b WHERE k < {rounds}) h{over}{groups}) g), z AS (SELECT sqrt(lo * hi) AS m FROM b WHERE k = {rounds})"


@query("WITH RECURSIVE v AS (SELECT o_totalprice::DOUBLE / 1000 AS x FROM orders WHERE o_totalprice IS NOT NULL), s AS (SELECT min(x) AS low, avg(x) AS mean, count(*) AS n FROM v), " + _bisected("1 / m - max(mean - low) + sum(exp(-m * (x - low)) * (x - low)) / sum(exp(-m * (x - low)))", over=", v, s", low=1e-6, high=1e3) + " SELECT round(max(low) - ln(sum(exp(-m * (x - low))) / max(n)) / max(m), 5) AS mu, round(max(m), 8) AS lambda, max(n) AS n FROM z, v, s")
def q37_fit_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL halves the interval in which the score equation has its zero."""
    fit = numeric.fit_gumbel(_t(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("x")), "x")
    return _r(_r(fit, 5, "mu"), 8, "lambda")


_CODON = "substr('{0}', (16 * (instr('TCAG', substr(c, 1, 1)) - 1) + 4 * (instr('TCAG', substr(c, 2, 1)) - 1) + instr('TCAG', substr(c, 3, 1)))::BIGINT, 1)"


def _frames_sql(table: str, key: str, text: str, code: int) -> str:
    residues = "".join(sequence.codon_map(code)[a + b + c] for a in "TCAG" for b in "TCAG" for c in "TCAG")
    return f"""WITH d AS (SELECT {key}, {_DNA.format(text)} AS s FROM {table}), st AS (SELECT {key}, 1 AS strand, s FROM d UNION ALL SELECT {key}, -1, reverse(translate(s, 'ACGT', 'TGCA')) FROM d),
pr AS (SELECT {key}, strand, f AS frame, array_to_string(list_transform(regexp_extract_all(substr(s, f + 1), '...'), lambda c: {_CODON.format(residues)}), '') AS protein FROM st, unnest([0, 1, 2]) u(f)) """


@query(_frames_sql("documents", "doc_id", "text", 1) + f""", x AS (SELECT doc_id, strand, frame, string_split(protein, '*') AS parts FROM pr), y AS (SELECT doc_id, strand, frame, parts, unnest(range(1, len(parts) + 1)) AS k FROM x)
SELECT doc_id, strand::INT AS strand, frame::INT AS frame, (1 + coalesce(list_sum(list_transform(parts[1:k - 1], lambda z: length(z) + 1)), 0))::BIGINT AS at, parts[k] AS orf FROM y WHERE length(parts[k]) >= {FRAME_LEAST}""")
def q38_open_reading_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.open_reading_frames(_t(spark, sf_dir, "documents"), symbols.as_dna(F.col("text")), "doc_id", least=FRAME_LEAST)


_KEYS = "(SELECT c_custkey AS key FROM customer UNION ALL SELECT -c_custkey - 1 FROM customer)"


@query(f"SELECT key, coalesce(n, 0)::BIGINT AS n_found, s_name FROM {_KEYS} LEFT JOIN (SELECT k, count(*) AS n, min(s_name) AS s_name FROM (SELECT DISTINCT k, s_suppkey, s_name FROM (SELECT s_suppkey AS k, s_suppkey, s_name FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, s_name FROM supplier)) GROUP BY k) ON key = k")
def q39_fetch_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _t(spark, sf_dir, "customer").select(F.explode(F.array("c_custkey", -F.col("c_custkey") - 1)).alias("key"))
    supplier = _t(spark, sf_dir, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("long"))
    return sequence.fetch_by_key(keys, supplier, "key", ["s_suppkey", "s_nationkey"], ["s_name"])


def _draw_sql(seed: int, *keys: str) -> str:
    parts = " || ".join(f"':' || coalesce(({k})::VARCHAR, '')" for k in keys)
    return f"('0x' || substr(md5('{seed}' || {parts}), 1, {draws.DIGITS}))::BIGINT"


@query(f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {_draw_sql(42, 'doc_id')}, doc_id LIMIT 100")
def q40_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sample_rows(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), 100, seed=42, key="doc_id")


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{storage.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT doc_id::VARCHAR AS name, coalesce(lang, '') AS description, md5({_RES.format('text')}) AS seq_md5 FROM documents WHERE text IS NOT NULL")
def q41_fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _t(spark, sf_dir, "documents").where("text IS NOT NULL"), _scratch(spark, "fasta")
    sequences.save(sequences.to_fasta(docs, name=F.col("doc_id").cast("string"), seq=symbols.residues_only(F.col("text")), description=F.coalesce("lang", F.lit(""))), path)
    return sequences.read_fasta(spark, path).select("name", "description", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(f"SELECT p_partkey, {_DNA.format('p_name')} AS seq FROM part")
def q42_packed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "packed")
    part = _t(spark, sf_dir, "part").select("p_partkey", symbols.as_dna(F.col("p_name")).alias("seq"))
    packed.write(part, path, key="p_partkey", seq="seq", names=["p_partkey"], partitions=spark.sparkContext.defaultParallelism)
    return packed.read(spark, path)


@query("WITH m AS (SELECT p_brand, list_sort(list(length(p_name)))[count(*)::BIGINT // 2 + 1] AS med FROM part GROUP BY 1) SELECT p_partkey, p_brand, length(p_name)::INT AS n FROM part JOIN m USING (p_brand) WHERE length(p_name) >= med")
def q43_median_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.by_median_length(_t(spark, sf_dir, "part"), "p_name", "p_brand", low=1.0).select("p_partkey", "p_brand", F.length("p_name").alias("n"))


@query(_NAMES_SQL + ", k AS (SELECT aln, col FROM res GROUP BY ALL HAVING count(*) FILTER (WHERE res = '-') / count(*)::DOUBLE <= 0.5) SELECT aln, key, string_agg(res, '' ORDER BY col) AS aseq FROM res JOIN k USING (aln, col) GROUP BY ALL")
def q44_masked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _names(spark, sf_dir)
    return editing.rows_from_residues(editing.by_columns(res, alignment.occupancy(res)))


@query(f"WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS newname, l_quantity::INT % 6 + 1 AS s, l_suppkey::INT % 6 + 1 AS e, {_DNA.format('p_name')} AS d FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT newname, CASE WHEN s > e THEN reverse(translate(substr(d, e, s - e + 1), 'ACGT', 'TGCA')) ELSE substr(d, s, e - s + 1) END AS subseq FROM r")
def q45_fetch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda c: (F.col(c).cast("int") % 6 + 1).cast("int")
    requests = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("newname"), place("l_quantity").alias("start"), place("l_suppkey").alias("end"), F.col("l_partkey").alias("source"))
    table = _t(spark, sf_dir, "part").select("p_partkey", symbols.as_dna(F.col("p_name")).alias("d"))
    return editing.fetch_ranges(requests, table, source="p_partkey", seq="d")


_BOUND = [(1, 2), (3, 6), (4, 5)]
_BOUND_SQL = _NAMES_SQL + ", pc AS (SELECT x.aln, x.col AS i, y.col AS j, x.res AS a, y.res AS b, count(*) AS n FROM res x JOIN res y ON x.aln = y.aln AND x.key = y.key JOIN (VALUES (1, 2), (3, 6), (4, 5)) v(i, j) ON x.col = v.i AND y.col = v.j WHERE x.res <> '-' AND y.res <> '-' GROUP BY ALL) "


def _pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _names(spark, sf_dir)
    bound = res.select("aln").distinct().select("aln", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _BOUND])).alias("_p")).select("aln", "_p.*")
    return structure.pair_counts(res, bound)


@query(_BOUND_SQL + "SELECT aln, i::INT AS i, j::INT AS j, a, b, n FROM pc")
def q46_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_counts(spark, sf_dir)


@query(_BOUND_SQL + ", p AS (SELECT *, n / sum(n) OVER (PARTITION BY aln, i, j)::DOUBLE AS p FROM pc), q AS (SELECT *, sum(p) OVER (PARTITION BY aln, i, j, a) AS pa, sum(p) OVER (PARTITION BY aln, i, j, b) AS pb FROM p) SELECT aln, i::INT AS i, j::INT AS j, sum(n)::BIGINT AS n, round(sum(p * log2(p / (pa * pb))), 5) AS mi FROM q GROUP BY aln, i, j")
def q47_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(structure.mutual_information(_pair_counts(spark, sf_dir)), 5, "mi")


@query("""SELECT event_id, round(CASE WHEN value < 1 THEN 0 ELSE 1 - exp(-0.01 * (value - 1)) END, 8) AS exponential, round(exp(-exp(-0.02 * (value - 200))), 8) AS gumbel,
round(CASE WHEN 1 + 0.1 * 0.02 * (value - 200) <= 0 THEN 0 ELSE exp(-pow(1 + 0.1 * 0.02 * (value - 200), -10.0)) END, 8) AS gev,
round(CASE WHEN value < 0 THEN 0 ELSE 1 - exp(-pow(0.005 * value, 1.5)) END, 8) AS weibull FROM events WHERE value IS NOT NULL""")
def q48_distribution_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, d = F.col("value"), distributions
    out = _t(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", d.exponential_cdf(v, 1.0, 0.01).alias("exponential"), d.gumbel_cdf(v, 200.0, 0.02).alias("gumbel"), d.gev_cdf(v, 200.0, 0.02, 0.1).alias("gev"), d.weibull_cdf(v, 0.0, 0.005, 1.5).alias("weibull"))
    return _r(out, 8, "exponential", "gumbel", "gev", "weibull")


@query("SELECT p_partkey, repeat('0', length(bin(p_size)) - 1) || bin(p_size) AS gamma, repeat('0', length(bin(length(bin(p_size)))) - 1) || bin(length(bin(p_size))) || substr(bin(p_size), 2) AS delta, repeat('1', p_size // 8) || '0' || right('000' || bin(p_size % 8), 3) AS rice FROM part")
def q49_integer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", codecs.elias_gamma(n).alias("gamma"), codecs.elias_delta(n).alias("delta"), codecs.golomb_rice(n, 3).alias("rice"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q50_streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, in windows of an hour."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, as the stream reader takes a plain path for a folder and the table may be one file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    windows = streams.windowed_moments(stream, "ts", "value", ["event_type"], width="1 hour", late="1 day")
    out = streams.run_to_end(windows, _scratch(spark, "stream"), checkpoint=_scratch(spark, "stream-state"))
    return _r(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4, "total")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("pid >= 0.12").select(F.col("i").alias("a"), F.col("j").alias("b"))


@query(_PAIRS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f", l AS (SELECT i AS x, j AS y FROM p WHERE pid >= 0.12 UNION ALL SELECT j, i FROM p WHERE pid >= 0.12), o AS (SELECT k, row_number() OVER (ORDER BY {_draw_sql(1, 'k')}, k) AS r, coalesce((SELECT list(y) FROM l WHERE x = k), []) AS near FROM a), t AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS s UNION ALL SELECT o.r, CASE WHEN list_has_any(s, near) THEN s ELSE list_append(s, k) END FROM t JOIN o ON o.r = t.r + 1) SELECT unnest(s) AS node FROM t WHERE r = (SELECT count(*) FROM o)")
def q51_independent_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.independent_set(_items(spark, sf_dir).select(F.col("item_id").alias("node")), _linked(spark, sf_dir))


@query(_PAIRS_SQL + f", l AS (SELECT i AS x, j AS y FROM p WHERE pid >= 0.12 UNION ALL SELECT j, i FROM p WHERE pid >= 0.12), d AS (SELECT k, {_draw_sql(1, 'k')} / {draws.RANGE}::DOUBLE < 0.5 AS s FROM a) SELECT k AS node, CASE WHEN s THEN 'S' WHEN k IN (SELECT y FROM l JOIN d u ON u.k = x WHERE u.s) THEN NULL ELSE 'T' END AS side FROM d")
def q52_two_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.two_sets(_items(spark, sf_dir).select(F.col("item_id").alias("node")), _linked(spark, sf_dir))


@query(_PAIRS_SQL + ", l AS (SELECT i AS x, j AS y FROM p WHERE pid >= 0.12 UNION ALL SELECT j, i FROM p WHERE pid >= 0.12), s AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'S' WHEN k IN (SELECT y FROM l WHERE x % 2 = 0) THEN NULL ELSE 'T' END AS side FROM a) SELECT count(*) FILTER (WHERE side = 'S') AS n_s, count(*) FILTER (WHERE side = 'T') AS n_t, count(*) FILTER (WHERE side IS NULL) AS n_left_out, (SELECT count(*) FROM p JOIN s u ON u.k = p.i JOIN s v ON v.k = p.j WHERE pid >= 0.12 AND u.side <> v.side) AS n_broken FROM s")
def q34_validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of a split by even numbers, and the links between them."""
    linked = _linked(spark, sf_dir)
    sets = storage.checkpoint(splitting.two_sets(_items(spark, sf_dir).select(F.col("item_id").alias("node")), linked, first=F.col("node") % 2 == 0))
    broken = splitting.broken_links(sets.where("side IS NOT NULL"), linked, within=False).agg(F.count("*").alias("n_broken"))
    return sets.agg(F.count_if(F.col("side") == "S").alias("n_s"), F.count_if(F.col("side") == "T").alias("n_t"), F.count_if(F.col("side").isNull()).alias("n_left_out")).crossJoin(F.broadcast(broken))


@query(None)
def q53_tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return _r(trees.weights(items, "aln", "item_id", _item_row(items)), 6, "weight")


@query(None)
def q54_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return trees.trees(items, "aln", "item_id", _item_row(items))


#: The digamma function at m: shifted up by ten, then by its asymptotic series.
_DIGAMMA = "(ln(m + 10) - 1 / (2 * (m + 10)) - 1 / (12 * pow(m + 10, 2)) + 1 / (120 * pow(m + 10, 4)) - 1 / (252 * pow(m + 10, 6)) + 1 / (240 * pow(m + 10, 8))" + "".join(f" - 1 / (m + {k})" for k in range(10)) + ")"


@query("WITH RECURSIVE s AS (SELECT avg(value) AS mean, ln(avg(value)) - avg(ln(value)) AS c FROM events WHERE value > 0), " + _bisected(f"ln(m) - {_DIGAMMA} - (SELECT c FROM s)", low=1e-3, high=1e3) + " SELECT round(m / mean, 7) AS lambda, round(m, 7) AS tau FROM z, s")
def q55_fit_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam, tau = fits.fit_gamma(_t(spark, sf_dir, "events"), "value")
    return _r(spark.createDataFrame([(lam, tau)], "lambda double, tau double"), 7, "lambda", "tau")


@query("WITH RECURSIVE s AS (SELECT max(value) AS top FROM events), v AS (SELECT ln(value / top) AS y FROM events, s WHERE value > 0), " + _bisected("1 / m + avg(y) - sum(exp(m * y) * y) / sum(exp(m * y))", over=", v", low=1e-3, high=1e3) + " SELECT round(pow(avg(exp(m * y)), -1 / max(m)) / max(top), 7) AS lambda, round(max(m), 7) AS tau FROM z, v, s")
def q56_fit_weibull(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam, tau = fits.fit_weibull(_t(spark, sf_dir, "events"), "value")
    return _r(spark.createDataFrame([(lam, tau)], "lambda double, tau double"), 7, "lambda", "tau")


#: Two states over four nucleotides: an even one and one rich in C and G.
_TWO_STATES = models.HiddenMarkov("ACGT", [0.5, 0.5], [[0.85, 0.1], [0.1, 0.85]], [0.05, 0.05], [[0.25] * 4, [0.1, 0.4, 0.4, 0.1]])


def _log_sql(p: float) -> str:
    return f"'{math.log(p)!r}'::DOUBLE"


_RICH = "CASE WHEN substr(d, {0}, 1) IN ('C', 'G') THEN {1} ELSE {2} END"
_STAY, _MOVE, _EVEN = _log_sql(0.85), _log_sql(0.1), _log_sql(0.25)


@query(f"""WITH RECURSIVE a AS (SELECT p_partkey, {_DNA.format('p_name')} AS d FROM part),
r AS (SELECT p_partkey, d, 1 AS i, 0.125::DOUBLE AS f1, 0.5::DOUBLE * {_RICH.format('1', 0.4, 0.1)} AS f2, {_log_sql(0.5)} + {_EVEN} AS v1, {_log_sql(0.5)} + {_RICH.format('1', _log_sql(0.4), _log_sql(0.1))} AS v2, '0' AS p1, '1' AS p2 FROM a WHERE length(d) > 0
UNION ALL SELECT p_partkey, d, i + 1, (f1 * 0.85 + f2 * 0.1) * 0.25, (f1 * 0.1 + f2 * 0.85) * {_RICH.format('i + 1', 0.4, 0.1)}, greatest(v1 + {_STAY}, v2 + {_MOVE}) + {_EVEN}, greatest(v1 + {_MOVE}, v2 + {_STAY}) + {_RICH.format('i + 1', _log_sql(0.4), _log_sql(0.1))},
CASE WHEN v2 + {_MOVE} > v1 + {_STAY} THEN p2 ELSE p1 END || '0', CASE WHEN v2 + {_STAY} > v1 + {_MOVE} THEN p2 ELSE p1 END || '1' FROM r WHERE i < length(d))
SELECT p_partkey, round(ln((f1 + f2) * 0.05), 6) AS log_likelihood, CASE WHEN v2 > v1 THEN p2 ELSE p1 END AS states FROM r WHERE i = length(d)
UNION ALL SELECT p_partkey, CASE WHEN d = '' THEN 0 END, d FROM a WHERE coalesce(d, '') = ''""")
def q57_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", symbols.as_dna(F.col("p_name")).alias("d"))
    return part.select("p_partkey", F.round(models.log_likelihood(F.col("d"), _TWO_STATES), 6).alias("log_likelihood"), F.array_join(models.best_path(F.col("d"), _TWO_STATES), "").alias("states"))


@query("SELECT p_partkey, length(p_name)::INT AS n, array_to_string(list_sort(string_split(p_name, '')), '') AS letters FROM part WHERE p_name IS NOT NULL")
def q58_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted letters of shuffled names, which are those of the names."""
    mixed = _t(spark, sf_dir, "part").where("p_name IS NOT NULL").select("p_partkey", models.shuffled(F.col("p_name"), F.col("p_partkey"), seed=42).alias("s"))
    return mixed.select("p_partkey", F.length("s").alias("n"), F.array_join(F.array_sort(F.filter(F.split("s", ""), lambda c: c != "")), "").alias("letters"))


_HELD_SQL = _NAMES_SQL + ", h AS (SELECT aln, col, count(*) FILTER (WHERE res = '-') / count(*)::DOUBLE <= 0.5 AS held FROM res GROUP BY ALL), pl AS (SELECT *, sum(held::INT) OVER (PARTITION BY aln ORDER BY col) AS place FROM h)"


def _places(res: DataFrame) -> DataFrame:
    return annotation.numbered_places(alignment.occupancy(res).select("aln", "col", "keep"))


@query(_HELD_SQL + ", i AS (SELECT aln, place, key, count(*) AS n FROM res JOIN pl USING (aln, col) WHERE NOT held AND res <> '-' GROUP BY ALL), t AS (SELECT p_brand AS aln, count(*) AS n_all FROM part GROUP BY 1) SELECT aln, place::INT AS place, count(*) AS n_rows, round(count(*) / max(n_all)::DOUBLE, 6) AS share, round(avg(n), 6) AS mean_length FROM i JOIN t USING (aln) GROUP BY aln, place")
def q59_insert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _names(spark, sf_dir)
    return _r(annotation.insert_stats(res, _places(res)), 6, "share", "mean_length")


@query(_HELD_SQL + ", r AS (SELECT aln, key, place, res <> '-' AS has FROM res JOIN pl USING (aln, col) WHERE held), e AS (SELECT aln, key, min(place) AS lo, max(place) AS hi FROM r WHERE has GROUP BY ALL) SELECT aln, place::INT AS place, count(*) FILTER (WHERE has) AS n_residues, count(*) FILTER (WHERE NOT has) AS n_gaps, count(*) FILTER (WHERE place BETWEEN lo AND hi) AS n_spanning, count(*) FILTER (WHERE place BETWEEN lo AND hi AND NOT has) AS n_internal FROM r LEFT JOIN e USING (aln, key) GROUP BY aln, place")
def q60_place_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _names(spark, sf_dir)
    return annotation.coverage(res, _places(res))


_FLUSH_SQL = _NAMES_SQL + ", pl AS (SELECT i AS col, i <= 3 OR i > 9 AS held FROM unnest(range(1, 13)) u(i)), f AS (SELECT aln, key, res, CASE WHEN held THEN col ELSE 3 + row_number() OVER (PARTITION BY key, held ORDER BY (res = '-')::INT, col) END AS col FROM res JOIN pl USING (col)) SELECT aln, key, string_agg(res, '' ORDER BY col) AS aseq FROM f GROUP BY ALL"


@query(_FLUSH_SQL)
def q61_flush_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _names(spark, sf_dir)
    mask = res.select("aln", "col").distinct().withColumn("keep", ~F.col("col").between(4, 9))
    return editing.rows_from_residues(annotation.flush_left(res, annotation.numbered_places(mask)))


_MARKS_SQL = _NAMES_SQL + ", m AS (SELECT aln, key, col, CASE WHEN res = '-' THEN '.' ELSE substr('0123456789*', ((key + col * col) % 11 + 1)::BIGINT, 1) END AS pp FROM res), p AS (SELECT *, CASE pp WHEN '0' THEN 0.025 WHEN '*' THEN 0.975 WHEN '.' THEN NULL ELSE pp::DOUBLE / 10 END::DOUBLE AS mid, CASE pp WHEN '0' THEN 0.0 WHEN '*' THEN 0.95 WHEN '.' THEN NULL ELSE pp::DOUBLE / 10 - 0.05 END::DOUBLE AS low FROM (SELECT *, pp AS q FROM m))"
_MARKS_SQL = _MARKS_SQL.replace("pp::DOUBLE", "TRY_CAST(pp AS DOUBLE)")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = ((F.col("key") + F.col("col") * F.col("col")) % 11 + 1).cast("int")
    return _names(spark, sf_dir).select("aln", "key", "col", F.when(F.col("res") == "-", ".").otherwise(F.substr(F.lit("0123456789*"), place, F.lit(1))).alias("pp"))


_COUNTED = ", ".join(f"count(*) FILTER (WHERE pp = '{m}') AS n_{'star' if m == '*' else m}" for m in "0123456789*")


@query(_MARKS_SQL + f" SELECT aln, col::INT AS col, {_COUNTED}, count(*) FILTER (WHERE pp = '.') AS n_gaps, count(mid) AS n_marks, round(avg(mid), 6) AS mean_pp FROM p GROUP BY aln, col")
def q62_posterior_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(annotation.posterior_stats(_marks(spark, sf_dir), ["aln", "col"]), 6, "mean_pp")


@query(_MARKS_SQL + f" SELECT aln, key, {_COUNTED}, count(*) FILTER (WHERE pp = '.') AS n_gaps, count(mid) AS n_marks, round(avg(mid), 6) AS mean_pp FROM p GROUP BY aln, key")
def q63_posterior_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(annotation.posterior_stats(_marks(spark, sf_dir), ["aln", "key"]), 6, "mean_pp")


@query(_MARKS_SQL + " SELECT aln, col::INT AS col, count(low) > 0 AND count(*) FILTER (WHERE low >= 0.45 - 1e-9) >= 0.55 * count(low) AS keep FROM p GROUP BY aln, col")
def q64_posterior_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.posterior_mask(_marks(spark, sf_dir), least=0.45, share=0.55)


@query(_NAMES_SQL + ", c AS (SELECT aln, col, res, count(*) AS n FROM res WHERE res <> '-' GROUP BY ALL), s AS (SELECT x.res AS a, y.res AS b, sum(CASE WHEN x.res = y.res THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END)::BIGINT AS n FROM c x JOIN c y ON x.aln = y.aln AND x.col = y.col AND x.res <= y.res GROUP BY 1, 2 HAVING sum(CASE WHEN x.res = y.res THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END) > 0), h AS (SELECT s, sum(n) / 2.0::DOUBLE AS m FROM (SELECT a AS s, n FROM s UNION ALL SELECT b, n FROM s) GROUP BY 1) SELECT a, b, n, round(log2(n / (x.m * y.m / (SELECT sum(n) FROM s)::DOUBLE * CASE WHEN a = b THEN 1 ELSE 2 END)), 5) AS odds FROM s JOIN h x ON x.s = a JOIN h y ON y.s = b")
def q65_substitution_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(scoring.log_odds(scoring.substitution_counts(alignment.column_counts(_names(spark, sf_dir)))), 5, "odds")


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names again, each flush right in a wider row."""
    row = F.lpad(F.regexp_replace(symbols.residues_only(F.col("p_name")), "^$", "-"), NAME_WIDTH + 4, "-")
    return alignment.residue_table(_t(spark, sf_dir, "part"), "p_brand", "p_partkey", row)


_SHARED_SQL = f"WITH a AS (SELECT p_brand AS aln, p_partkey AS key, {_ALN.format('p_name', NAME_WIDTH)} AS s, lpad(regexp_replace({_RES.format('p_name')}, '^$', '-'), {NAME_WIDTH + 4}, '-') AS t FROM part), x AS (SELECT aln, key, i, row_number() OVER (PARTITION BY key ORDER BY i) AS k FROM a, unnest(range(1, {NAME_WIDTH + 1})) u(i) WHERE substr(s, i, 1) <> '-'), y AS (SELECT key, i AS j, row_number() OVER (PARTITION BY key ORDER BY i) AS k FROM a, unnest(range(1, {NAME_WIDTH + 5})) u(i) WHERE substr(t, i, 1) <> '-') SELECT aln, i::INT AS i, j::INT AS j, count(*) AS n FROM x JOIN y USING (key, k) GROUP BY aln, i, j"


@query(_SHARED_SQL)
def q66_shared_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.shared_residues(_names(spark, sf_dir), _shifted(spark, sf_dir))


@query(None)
def q67_column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_map(_names(spark, sf_dir), _shifted(spark, sf_dir))


@query("WITH RECURSIVE c AS (" + _SHARED_SQL + f"), g AS (SELECT aln, d.i, list(coalesce(n, 0) ORDER BY d.j) AS r FROM (SELECT aln, u.i, w.j FROM (SELECT DISTINCT aln FROM c), range(1, {NAME_WIDTH + 1}) u(i), range(1, {NAME_WIDTH + 5}) w(j)) d LEFT JOIN c USING (aln, i, j) GROUP BY ALL), t AS (SELECT aln, 0::BIGINT AS i, [0::BIGINT for x in range({NAME_WIDTH + 5})] AS m FROM (SELECT DISTINCT aln FROM c) UNION ALL SELECT t.aln, g.i, list_concat([0::BIGINT], [list_max([greatest(m[x + 1], m[x] + r[x]) for x in range(1, j + 1)]) for j in range(1, {NAME_WIDTH + 5})]) FROM t JOIN g ON g.aln = t.aln AND g.i = t.i + 1) SELECT aln, m[{NAME_WIDTH + 5}] AS total FROM t WHERE i = {NAME_WIDTH}")
def q67b_column_map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many residues the map of each alignment shares, which the SQL finds by dynamic programming over all pairs of columns."""
    mapped = columns.column_map(_names(spark, sf_dir), _shifted(spark, sf_dir))
    return mapped.groupBy("aln").agg(F.sum("n").alias("total"))


def _two_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = "xxxx..xxxxxx", "xxxxxx..xxxx"
    return _t(spark, sf_dir, "part").select(F.col("p_size").alias("aln"), F.col("p_partkey").alias("key"), symbols.aligned(F.col("p_name"), NAME_WIDTH).alias("aseq"), F.when(F.col("p_size") % 2 == 0, early).otherwise(late).alias("reference"))


@query(f"SELECT p_size AS aln, p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN concat(substr(s, 1, 8), '..', substr(s, 9, 4)) ELSE concat(substr(s, 1, 4), '..', substr(s, 5, 8)) END AS aseq FROM (SELECT *, {_ALN.format('p_name', NAME_WIDTH)} AS s FROM part)")
def q68_merged_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.merged(_two_references(spark, sf_dir))


@query(f"SELECT p_partkey AS key, length(replace(s, '-', ''))::BIGINT AS n, length(replace(concat(substr(s, 1, 4), substr(s, 9, 4)), '-', ''))::BIGINT AS \"right\", round(length(replace(concat(substr(s, 1, 4), substr(s, 9, 4)), '-', '')) / length(replace(s, '-', ''))::DOUBLE, 6) AS accuracy FROM (SELECT *, {_ALN.format('p_name', NAME_WIDTH)} AS s FROM part) WHERE length(replace(s, '-', '')) > 0")
def q69_alignment_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_references(spark, sf_dir)
    known, test = (rows.withColumn("reference", F.lit(r)) for r in ("xxxx..xxxxxx", "xxxxxx..xxxx"))
    return _r(editing.accuracy(known, test), 6, "accuracy")


@query("SELECT p_partkey, 4::BIGINT AS n_known, k::BIGINT AS n_predicted, k::BIGINT AS found, k::BIGINT AS \"right\", k / 4.0::DOUBLE AS sensitivity, least(k, 1)::DOUBLE AS ppv FROM (SELECT p_partkey, p_size % 5 AS k FROM part)")
def q70_structure_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.lit("<<<<....>>>>").alias("known"), F.concat(F.repeat(F.lit("<"), k), F.repeat(F.lit("."), 12 - 2 * k), F.repeat(F.lit(">"), k)).alias("test"))
    return structure.compare(structure.pair_table(rows, "p_partkey", "known"), structure.pair_table(rows, "p_partkey", "test"), "p_partkey")


@query("SELECT event_type, round(low - ln(mean) / 0.02, 5) AS mu FROM (SELECT event_type, min(low) AS low, avg(exp(-0.02 * (value - low))) AS mean FROM events JOIN (SELECT event_type, min(value) AS low FROM events GROUP BY 1) USING (event_type) GROUP BY 1)")
def q71_gumbel_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fits.gumbel_locations(_t(spark, sf_dir, "events"), "value", 0.02, ["event_type"]), 5, "mu")


@query(None)
def q72_fit_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of four families that have no closed form, for order prices or event values in thousands."""
    prices, values = _t(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("x")), _t(spark, sf_dir, "events").select("value")
    found = {"gumbel, truncated": fits.fit_gumbel_truncated(prices, "x", 100.0), "gev": fits.fit_gev(prices, "x"), "stretched": fits.fit_stretched(values, "value"), "hyperexponential": [v for part in fits.fit_hyperexponential(values, "value") for v in part]}
    return spark.createDataFrame([(k, [round(float(v), 5) for v in vs]) for k, vs in found.items()], "family string, parameters array<double>")


@query(None)
def q73_hidden_markov_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states over the vowels and consonants of names, from a rough start."""
    kinds = F.translate(symbols.residues_only(F.col("p_name")), symbols.UPPER, "".join("v" if c in "AEIOU" else "c" for c in symbols.UPPER))
    rough = models.HiddenMarkov("vc", [0.5, 0.5], [[0.4, 0.5], [0.5, 0.4]], [0.1, 0.1], [[0.6, 0.4], [0.3, 0.7]])
    model, history = models.train(_t(spark, sf_dir, "part").select(kinds.alias("s")), "s", rough, rounds=8)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in enumerate(history)], "round int, log_likelihood double")


@query("SELECT concat_ws(chr(9), p_brand, 'parts', 'match', l_linenumber::VARCHAR, (l_linenumber + 9)::VARCHAR, printf('%.1f', l_quantity::DOUBLE), CASE WHEN l_suppkey % 9 > l_partkey % 9 THEN '-' ELSE '+' END, '.', concat('gene \"', l_orderkey, '\"')) AS value FROM lineitem JOIN part ON l_partkey = p_partkey")
def q74_feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    hits = met.select(F.col("l_orderkey").cast("string").alias("query"), F.col("p_brand").alias("target"), F.col("l_quantity").cast("double").alias("score"), (F.col("l_suppkey") % 9).alias("qstart"), (F.col("l_partkey") % 9).alias("qend"), F.col("l_linenumber").alias("tstart"), (F.col("l_linenumber") + 9).alias("tend"))
    return reports.to_lines(hits, "gff", source="parts", feature="match")


@query(_NAMES_SQL + ", k AS (SELECT aln, col, row_number() OVER (PARTITION BY aln ORDER BY col) AS place FROM res GROUP BY aln, col HAVING bool_or(res <> '-')) SELECT aln, key, string_agg(res, '' ORDER BY place) AS aseq FROM res JOIN k USING (aln, col) GROUP BY ALL")
def q75_without_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _names(spark, sf_dir)
    return editing.rows_from_residues(editing.by_columns(res, editing.gap_mask(res)))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q76_rows_not_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return editing.by_names(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), listed, "o_custkey", keep=False)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), z AS (SELECT *, list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS z FROM v), p AS (SELECT *, list_transform(v, lambda x: exp(x - z)) AS p FROM z)
SELECT vec_id, round(list_sum(v), 5) AS total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS norm, list_position(v, list_max(v))::BIGINT AS arg_max, list_position(v, list_min(v))::BIGINT AS arg_min, round(z, 5) AS log_sum_exp, round(-list_sum(list_transform(p, lambda x: x * log2(x))), 5) AS entropy, round(list_sum(list_transform(p, lambda x: x * log2(x * len(p)))), 5) AS rel_entropy FROM p""")
def q77_vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = F.col("v")
    p = df.withColumns({"p": vectors.log_normalised(v), "even": F.transform(v, lambda x: F.lit(1.0) / F.size(v))})
    out = p.select("vec_id", vectors.total(v).alias("total"), vectors.norm(v).alias("norm"), vectors.arg_max(v).cast("long").alias("arg_max"), vectors.arg_min(v).cast("long").alias("arg_min"), vectors.log_sum_exp(v).alias("log_sum_exp"), vectors.entropy(F.col("p")).alias("entropy"), vectors.relative_entropy(F.col("p"), F.col("even")).alias("rel_entropy"))
    return _r(out, 5, "total", "norm", "log_sum_exp", "entropy", "rel_entropy")


@query("SELECT p_partkey, replace(replace(translate(p_name, 'Uu', 'Tt'), '-', '.'), '_', '.') AS dna, translate(translate(upper(p_name), 'RYMKSWHBVD', 'NNNNNNNNNN'), 'X', 'N') AS plain, translate(p_name, 'aeiou', '*****') AS vowels FROM part")
def q78_symbol_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", symbols.converted(name, "dna", gap=".").alias("dna"), symbols.converted(name, "upper", "no_degenerate", "no_x").alias("plain"), symbols.converted(name, replace=("aeiou", "*")).alias("vowels"))


#: Four structures over twelve columns, by part size.
_SHAPES = ("<<<<....>>>>", "<<<.....>>>.", ".<<<....>>>.", "............")
_SHAPES_SQL = "WITH r AS (SELECT p_brand AS aln, p_partkey AS key, p_size % 4 AS k FROM part), s AS (SELECT * FROM (VALUES (0, 1, 12), (0, 2, 11), (0, 3, 10), (0, 4, 9), (1, 1, 11), (1, 2, 10), (1, 3, 9), (2, 2, 11), (2, 3, 10), (2, 4, 9)) t(k, i, j)), n AS (SELECT aln, i, j, count(*) AS n FROM r JOIN s USING (k) GROUP BY ALL), u AS (SELECT aln, i, j, n, n / c::DOUBLE AS share FROM n JOIN (SELECT aln, count(*) AS c FROM r GROUP BY 1) USING (aln)), e AS (SELECT aln, i AS col, share FROM u UNION ALL SELECT aln, j, share FROM u), b AS (SELECT aln, max(share) AS least FROM (SELECT aln, share FROM e QUALIFY row_number() OVER (PARTITION BY aln, col ORDER BY share DESC) = 2) GROUP BY 1)"


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.element_at(F.array(*[F.lit(s) for s in _SHAPES]), F.col("p_size") % 4 + 1)
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("aln"), F.col("p_partkey").alias("key"), shape.alias("s"))
    pairs = structure.pair_table(rows.withColumn("k", F.struct("aln", "key")), "k", "s").select("k.*", "i", "j")
    return structure.pair_support(pairs, rows)


@query(_SHAPES_SQL + " SELECT aln, i, j, n, round(share, 6) AS share FROM u LEFT JOIN b USING (aln) WHERE share > coalesce(least, 0)")
def q79_consistent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(structure.consistent_pairs(_support(spark, sf_dir)), 6, "share")


@query(_SHAPES_SQL + " SELECT aln, col, count(*) AS n_partners FROM e GROUP BY aln, col HAVING count(*) > 1")
def q80_pair_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.conflicts(_support(spark, sf_dir))


def _share_sql(key: str) -> str:
    return f"{_draw_sql(7, 'id', key)} / {draws.RANGE}::DOUBLE"


@query(f"""WITH RECURSIVE u AS (SELECT id, i, {_share_sql('i')} AS u FROM range(100) x(id), range(1, 61) y(i)),
c AS (SELECT id, 1 AS i, CASE WHEN {_share_sql('1')} < 0.5 THEN 'A' ELSE 'C' END AS seq FROM range(100) x(id)
UNION ALL SELECT id, i + 1, seq || CASE WHEN right(seq, 1) = 'A' AND {_share_sql('i + 1')} < 0.75 THEN 'C' ELSE 'A' END FROM c WHERE i < 60)
SELECT id, string_agg(CASE WHEN u < 1 / 6::DOUBLE THEN 'A' WHEN u < 3 / 6::DOUBLE THEN 'C' WHEN u < 5 / 6::DOUBLE THEN 'G' ELSE 'T' END, '' ORDER BY i) AS seq FROM u GROUP BY id UNION ALL SELECT id, seq FROM c WHERE i = 60""")
def q81_random_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.independent(spark, 100, 60, {"A": 1, "C": 2, "G": 2, "T": 1}, seed=7).unionByName(generation.chained(spark, 100, 60, {"A": 1, "C": 1}, {"A": {"C": 3, "A": 1}, "C": {"A": 1}}, seed=7))


@query(_PAIRS_SQL + "SELECT 1 AS aln, count(*) AS nseq, max(length(s))::INT AS alen, sum(n)::BIGINT AS nres, min(n)::INT AS small, max(n)::INT AS large, round(avg(n), 6) AS avlen, (SELECT round(avg(pid), 6) FROM p) AS pid FROM a")
def q82_alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return _r(alignment.summary(items, "aln", "item_id", _item_row(items), most_pairs=None), 6, "avlen", "pid")


_SHARES = ", ".join(f"('{c}', '{s}', {v!r}::DOUBLE)" for c, s, v in alignment.alphabet_shares("amino"))


@query(_NAMES_SQL + f", w AS (SELECT p_partkey AS key, p_size / 10.0::DOUBLE AS w FROM part), t AS (SELECT * FROM (VALUES {_SHARES}) v(code, symbol, share)) SELECT aln, col::INT AS col, symbol AS res, round(sum(w * share), 5) AS n FROM res JOIN w USING (key) JOIN t ON res = code GROUP BY ALL")
def q83_weighted_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("aln"), F.col("p_partkey").alias("key"), (F.col("p_size") / 10).alias("weight"))
    return _r(alignment.spread_counts(_names(spark, sf_dir), "amino", weights=weights), 5, "n")


@query(f"SELECT 'GR' AS kind, p_partkey::VARCHAR AS name, 'PP' AS tag, regexp_replace({_ALN.format('p_name', NAME_WIDTH)}, '[A-Z]', '9', 'g') AS value FROM part UNION ALL SELECT 'GC', NULL, 'RF', repeat('x', {NAME_WIDTH}) FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'GF', NULL, 'ID', p_brand FROM (SELECT DISTINCT p_brand FROM part)")
def q84_annotation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated text of one alignment per brand, written and read again."""
    part, path = _t(spark, sf_dir, "part"), _scratch(spark, "annotated")
    rows = part.select(F.col("p_brand").alias("aln"), F.col("p_partkey").alias("seqidx"), F.col("p_partkey").cast("string").alias("name"), symbols.aligned(F.col("p_name"), NAME_WIDTH).alias("aseq"))
    note = lambda df, kind, name, tag, value: df.select("aln", F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.lit(tag).alias("tag"), value.alias("value"))
    brands = rows.select("aln").distinct()
    notes = note(rows, "GR", F.col("name"), "PP", F.regexp_replace("aseq", "[A-Z]", "9")).unionByName(note(brands, "GC", F.lit(None), "RF", F.lit("x" * NAME_WIDTH))).unionByName(note(brands, "GF", F.lit(None), "ID", F.col("aln")))
    alignments.to_annotated(rows, notes).select("value").write.text(path)
    return alignments.read_annotations(spark, path).select("kind", "name", "tag", "value")


@query(f"SELECT min(bin * 5000.0::DOUBLE) FILTER (WHERE bin * 5000.0 >= 60000) AS phi, coalesce(sum(obs) FILTER (WHERE bin * 5000.0 >= 60000), 0)::BIGINT AS n_tail, sum(obs)::BIGINT AS n_all FROM {_BINS}")
def q85_tail_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.tail_by_score(_price_bins(spark, sf_dir), 60000.0)


@query(f"SELECT bin, (bin + 1) * 5000.0::DOUBLE AS hi, round(900 - ln(1 - p) / 0.00002, 4) AS expected FROM (SELECT bin, (sum(obs) OVER (ORDER BY bin) / sum(obs) OVER ())::DOUBLE AS p FROM {_BINS}) WHERE p < 1")
def q86_quantile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(numeric.quantile_pairs(_price_bins(spark, sf_dir), lambda p: distributions.exponential_inverse(p, 900.0, 0.00002)), 4, "expected")


_PRICE_CDF = "CASE WHEN {0} < 900 THEN 0 ELSE 1 - exp(-0.00002::DOUBLE * ({0} - 900)) END"


@query(f"SELECT bin, bin * 5000.0::DOUBLE AS lo, (bin + 1) * 5000.0::DOUBLE AS hi, obs, round(sum(obs) OVER () * ({_PRICE_CDF.format('(bin + 1) * 5000.0::DOUBLE')} - {_PRICE_CDF.format('bin * 5000.0::DOUBLE')}), 4) AS expected FROM {_BINS}")
def q87_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(numeric.expected_counts(_price_bins(spark, sf_dir), lambda x: distributions.exponential_cdf(x, 900.0, 0.00002)), 4, "expected")


@query(_frames_sql("part", "p_partkey", "p_name", 2) + "SELECT p_partkey, strand::INT AS strand, frame::INT AS frame, protein FROM pr")
def q88_another_genetic_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.translate_frames(_t(spark, sf_dir, "part"), symbols.as_dna(F.col("p_name")), "p_partkey", code=2)


@query("SELECT p_brand AS aln, p_partkey AS key FROM part WHERE p_size < 5 OR p_size > 45")
def q89_differing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", symbols.aligned(F.col("p_name"), NAME_WIDTH).alias("aseq"))
    other = rows.where("p_size <= 45").withColumn("aseq", F.when(F.col("p_size") < 5, F.concat(F.lit("?"), F.substring("aseq", 2, NAME_WIDTH))).otherwise(F.lower(F.translate("aseq", "-", "."))))
    return alignment.differing(rows, other, "p_brand", "p_partkey", "aseq")


@query(_NAMES_SQL + "SELECT aln, key, string_agg(res, '' ORDER BY col) AS aseq FROM res WHERE col BETWEEN 3 AND 8 GROUP BY ALL")
def q90_columns_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.rows_from_residues(alignment.columns_between(_names(spark, sf_dir), 3, 8))


@query("SELECT p_brand AS aln, p_type AS name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def q91_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.repeated_names(_t(spark, sf_dir, "part"), "p_brand", "p_type")


_GEV_T = "(1 + 0.1::DOUBLE * 0.02 * (value - 200))"


@query(f"""SELECT event_id, round(CASE WHEN value < 1 THEN 0 ELSE -0.01 * (value - 1) END, 7) AS exponential_log_survival, round(ln(0.02) - 0.02 * (value - 200) - exp(-0.02 * (value - 200)), 7) AS gumbel_log_pdf,
round(-exp(-0.02 * (value - 200)), 7) AS gumbel_log_cdf, round(CASE WHEN {_GEV_T} > 0 THEN 0.02 * pow({_GEV_T}, -11.0) * exp(-pow({_GEV_T}, -10.0)) ELSE 0 END, 9) AS gev_pdf,
round(CASE WHEN value < 0 THEN 0 ELSE -pow(0.005 * value, 1.5) END, 7) AS weibull_log_survival, round(0.3 * CASE WHEN {_GEV_T} > 0 THEN exp(-pow({_GEV_T}, -10.0)) ELSE 0 END + 0.7 * exp(-exp(-0.03 * (value - 300))), 8) AS mixture_cdf FROM events WHERE value IS NOT NULL""")
def q92_distribution_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    gev = families.extreme_value(200.0, 0.02, 0.1)
    out = _t(spark, sf_dir, "events").where("value IS NOT NULL").select(
        "event_id", families.exponential(1.0, 0.01).log_survival(v).alias("exponential_log_survival"), families.gumbel(200.0, 0.02).log_pdf(v).alias("gumbel_log_pdf"), families.gumbel(200.0, 0.02).log_cdf(v).alias("gumbel_log_cdf"),
        gev.pdf(v).alias("gev_pdf"), families.weibull(0.0, 0.005, 1.5).log_survival(v).alias("weibull_log_survival"), families.extreme_value_mixture([(0.3, 200.0, 0.02, 0.1), (0.7, 300.0, 0.03, 0.0)]).cdf(v).alias("mixture_cdf"),
    )
    return _r(_r(_r(out, 7, "exponential_log_survival", "gumbel_log_pdf", "gumbel_log_cdf", "weibull_log_survival"), 9, "gev_pdf"), 8, "mixture_cdf")


@query("WITH m AS (SELECT p_brand AS i, p_size AS j, count(*)::DOUBLE AS v FROM part GROUP BY ALL) SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM m x JOIN m y ON x.j = y.j GROUP BY ALL")
def q93_matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by sizes, times its transpose."""
    counts = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("i"), F.col("p_size").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return matrices.product(counts, matrices.transposed(counts))


@query("WITH m AS (SELECT o_orderstatus AS i, o_orderpriority AS j, count(*)::DOUBLE AS v FROM orders GROUP BY ALL) SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 8) AS v FROM m")
def q94_normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("i"), F.col("o_orderpriority").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return _r(matrices.normalised_rows(counts), 8, "v")


@query(f"WITH a AS (SELECT {_ALN.format('p_name', NAME_WIDTH)} AS s FROM part) SELECT i::INT AS col, substr(s, i, 1) AS res, count(*) AS n FROM a, unnest(range(1, {NAME_WIDTH + 1})) u(i) GROUP BY ALL")
def q95_line_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column counts straight from the lines of a written alignment."""
    part, path = _t(spark, sf_dir, "part"), _scratch(spark, "lines")
    part.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), symbols.aligned(F.col("p_name"), NAME_WIDTH)).alias("value")).write.text(path)
    return alignments.column_counts(spark, path).groupBy("col", "res").agg(F.sum("n").alias("n"))


_ROWS_SQL = f"WITH a AS (SELECT p_partkey, p_brand, {_ALN.format('p_name', NAME_WIDTH)} AS s FROM part) SELECT p_partkey, string_agg({{0}}, '' ORDER BY {{1}}) AS aseq FROM a, unnest(range(1, {NAME_WIDTH + 1})) u(i) GROUP BY p_partkey"


@query(_ROWS_SQL.format("substr(s, i, 1)", f"{_draw_sql(5, 'p_brand', 'i')}, i"))
def q96_shuffled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    aseq = generation.shuffled_columns(symbols.aligned(F.col("p_name"), NAME_WIDTH), F.col("p_brand"), seed=5)
    return _t(spark, sf_dir, "part").select("p_partkey", aseq.alias("aseq"))


@query(_ROWS_SQL.format(f"substr(s, {_draw_sql(5, 'p_brand', 'i')} % {NAME_WIDTH} + 1, 1)", "i"))
def q97_resampled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    aseq = generation.resampled_columns(symbols.aligned(F.col("p_name"), NAME_WIDTH), F.col("p_brand"), seed=5)
    return _t(spark, sf_dir, "part").select("p_partkey", aseq.alias("aseq"))


@query("SELECT p_partkey, p_name, place FROM part LEFT JOIN (SELECT l_partkey, count(*) AS place FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def q98_reordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order of their number of orders."""
    order = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("place"))
    return editing.reordered(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), order, "p_partkey", rest=True)


@query(_HELD_SQL + ", n AS (SELECT aln, key, count(*) FILTER (WHERE res <> '-') AS n, count(*) AS total FROM res JOIN pl USING (aln, col) WHERE held GROUP BY ALL) SELECT aln, key, n FROM n WHERE n >= 0.8 * total")
def q99_by_reference_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _names(spark, sf_dir)
    return annotation.by_reference_length(res, _places(res), least=0.8)


@query(f"SELECT p_partkey::VARCHAR AS name, {_RES.format('p_name')} AS seq FROM part WHERE p_name IS NOT NULL")
def q100_terminated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a daemon is sent them, written and read."""
    part, path = _t(spark, sf_dir, "part").where("p_name IS NOT NULL"), _scratch(spark, "daemon")
    text = sequences.to_fasta(part, name=F.col("p_partkey").cast("string"), seq=symbols.residues_only(F.col("p_name")))
    sequences.save(text.select(F.concat("value", F.lit("\n//")).alias("value")), path)
    return sequences.read(spark, path, "daemon").select("name", "seq")


@query(_NAMES_SQL + f", r AS (SELECT *, row_number() OVER (PARTITION BY aln, col ORDER BY key) AS k, row_number() OVER (PARTITION BY aln, col ORDER BY {_draw_sql(9, 'aln', 'key', 'col')}, key) AS d FROM res) SELECT x.aln, x.key, string_agg(y.res, '' ORDER BY x.col) AS aseq FROM r x JOIN r y ON x.aln = y.aln AND x.col = y.col AND x.k = y.d GROUP BY ALL")
def q101_shuffled_within_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editing.rows_from_residues(generation.shuffled_within_columns(_names(spark, sf_dir), seed=9))


def _within_sql(groups: tuple[str, ...]) -> str:
    return " OR ".join(f"bool_and(contains('{g}', res))" for g in groups)


@query(_NAMES_SQL + f" SELECT aln, col::INT AS col, CASE WHEN NOT ({_within_sql((alignment.AMINO,))}) THEN ' ' WHEN count(DISTINCT res) = 1 THEN '*' WHEN {_within_sql(alignment.STRONG_GROUPS)} THEN ':' WHEN {_within_sql(alignment.WEAK_GROUPS)} THEN '.' ELSE ' ' END AS mark FROM res GROUP BY ALL")
def q102_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.conservation(_names(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str, j: str) -> DataFrame:
    """Two by two counts of orders for each priority, with heavy diagonals."""
    n = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), (F.col("o_orderkey") % 2).alias("i"), F.expr(j).alias("j")).agg(F.count("*").alias("n"))
    return n.select("g", "i", "j", (F.col("n") + F.when(F.col("i") == F.col("j"), 100000).otherwise(0)).cast("double").alias("v"))


@query("WITH m AS (SELECT o_orderpriority AS g, 100000 + count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_custkey % 2 = 0)::DOUBLE AS a, count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_custkey % 2 = 1)::DOUBLE AS b, count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_custkey % 2 = 0)::DOUBLE AS c, 100000 + count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_custkey % 2 = 1)::DOUBLE AS d FROM orders GROUP BY 1) SELECT g, i, j, round(CASE WHEN i = 0 AND j = 0 THEN d WHEN i = 1 AND j = 1 THEN a WHEN i = 0 THEN -b ELSE -c END / (a * d - b * c), 12) AS v FROM m, range(2) x(i), range(2) y(j)")
def q103_matrix_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(matrices.inverse(_tables(spark, sf_dir, "o_custkey % 2"), ["g"]), 12, "v")


@query("WITH m AS (SELECT o_orderpriority AS g, 100000 + count(*) FILTER (WHERE o_orderkey % 2 = 0)::DOUBLE AS a, 100000 + count(*) FILTER (WHERE o_orderkey % 2 = 1)::DOUBLE AS d, count(*)::DOUBLE AS b FROM orders GROUP BY 1) SELECT g, k::INT AS k, round((a + d) / 2 + (3 - 2 * k) * sqrt((a - d) * (a - d) / 4 + b * b), 6) AS v FROM m, range(1, 3) x(k)")
def q104_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even and odd orders of each priority on the diagonal, all of them beside it."""
    diagonal = _tables(spark, sf_dir, "o_orderkey % 2")
    total = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.count("*").cast("double").alias("v"))
    beside = total.select("g", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")), F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")))).alias("c"), "v").select("g", F.col("c.i").cast("long").alias("i"), F.col("c.j").cast("long").alias("j"), "v")
    return _r(matrices.eigenvalues(diagonal.unionByName(beside), ["g"]), 6, "v")


@query(_NAMES_SQL + ", pl AS (SELECT i AS col, i <= 3 OR i > 9 AS held FROM unnest(range(1, 13)) u(i)), g AS (SELECT aln, key, min(col) FILTER (WHERE NOT held AND res <> '-') AS at FROM res JOIN pl USING (col) GROUP BY ALL), p AS (SELECT x.aln, x.key AS a, y.key AS b, (x.at = y.at) IS TRUE AS same, (x.at IS NOT NULL OR y.at IS NOT NULL) AS has FROM g x JOIN g y ON x.aln = y.aln AND x.key <> y.key WHERE x.key % 50 = 0) SELECT aln, a, b, same::BIGINT AS n_shared, has::BIGINT AS n_inserts, CASE WHEN has THEN same::INT::DOUBLE ELSE 1 END AS share FROM p")
def q105_shared_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose number is divisible by 50 against all of their brand."""
    res = _names(spark, sf_dir)
    mask = res.select("aln", "col").distinct().withColumn("keep", (F.col("col") <= 3) | (F.col("col") > 9))
    return annotation.shared_inserts(res, annotation.numbered_places(mask), res.where("col = 1 AND key % 50 = 0").select("aln", "key"))


@query(None)
def q106_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return trees.partition(items, "aln", "item_id", _item_row(items), 5)


_RANGE_SQL = "concat(l_partkey, CASE l_linenumber % 4 WHEN 0 THEN '..' WHEN 1 THEN '-' WHEN 2 THEN ' to ' ELSE '' END, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey::VARCHAR ELSE '' END)"


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, {_RANGE_SQL} AS t FROM lineitem), p AS (SELECT *, string_split(regexp_replace(t, '[^0-9]+', ':'), ':') AS x FROM t) SELECT l_orderkey, l_linenumber, CASE WHEN len(x) = 2 THEN x[1]::BIGINT END AS first, CASE WHEN len(x) = 2 THEN CASE WHEN x[2] = '' THEN 0 ELSE x[2]::BIGINT END END AS last FROM p")
def q107_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges in several spellings, some without an end and some without a sign between the numbers."""
    lines = _t(spark, sf_dir, "lineitem")
    sign = F.element_at(F.array(*map(F.lit, ("..", "-", " to ", ""))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat(F.col("l_partkey").cast("string"), sign, F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey").cast("string")).otherwise(""))
    return lines.select("l_orderkey", "l_linenumber", symbols.coordinates(text).alias("c")).select("l_orderkey", "l_linenumber", "c.first", "c.last")
