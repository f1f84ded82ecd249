"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "the of and to in is that was for it with as on be at by this had not are but from or have an they which a he she his her we you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass sie nach wird bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya fue este".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document passes if `measure` is within [least, most]; a null measure passes."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Measures are the columns of `measures`.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.1),
    Rule("shouting_per_word", "shout_ratio", None, 0.25),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.3),
)
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50



def stop_forms() -> list[str]:
    """The stop words as written inside and at the start of a sentence; shouted words do not count."""
    words = {w for ws in STOP_WORDS.values() for w in ws}
    return sorted(words | {w.capitalize() for w in words})


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `keep`, and the counts and ratios of each text, all by built-in functions.

    Three projections, so that each array is made once; no shuffle. A null or empty text has counts
    of 0 and null ratios.
    """
    stop = stop_forms()
    stop_list = ", ".join(f"'{w}'" for w in stop)
    text = f"coalesce(`{text_col}`, '')"
    seps = r"' \t\n\u000B\u000C\r'"
    kept = [F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]]
    base = docs.select(
        *kept,
        F.expr(rf"split(trim(BOTH {seps} FROM {text}), '[\\x20\\x09-\\x0D]+')").alias("_w"),
        F.expr(rf"filter(split({text}, '\n'), x -> length(trim(BOTH {seps} FROM x)) > 0)").alias("_lines"),
        F.expr(rf"length({text}) - length(regexp_replace({text}, '[#*$%&|<>]', ''))").alias("n_symbols"),
        F.expr(rf"length({text}) - length(replace({text}, '!', ''))").alias("_shouts"),
    )
    first = base.select(
        *[c for c in base.columns if c.startswith("_id") or c.startswith("_keep_")],
        "_w",
        F.expr("if(element_at(_w, 1) = '', 0, size(_w))").cast("long").alias("n_words"),
        F.expr("length(array_join(_w, ''))").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.expr("size(_lines)").cast("long").alias("n_lines"),
        F.expr("size(_lines) - size(array_distinct(_lines))").cast("long").alias("n_dup_lines"),
        F.col("_shouts").cast("long").alias("n_shouts"),
        F.expr(f"size(filter(_w, x -> x IN ({stop_list})))").cast("long").alias("n_stop_words"),
        F.expr("sort_array(if(size(_w) < 3, array(), slice(arrays_zip(_w, slice(_w, 2, size(_w)), slice(_w, 3, size(_w)), sequence(0, size(_w) - 1)), 1, size(_w) - 2)))").alias("_s"),
    ).drop("_w")
    # equal windows stand side by side; each pair gives its two places
    same = " AND ".join(f"x.`0`.`{k}` = x.`1`.`{k}`" for k in ("_w", 1, 2))
    pairs = f"filter(arrays_zip(slice(_s, 1, greatest(size(_s) - 1, 0)), slice(_s, 2, size(_s))), x -> {same})"
    second = first.withColumn("_pairs", F.expr(pairs)).drop("_s")
    counted = second.withColumn("n_repeat_words", F.expr("size(array_distinct(flatten(transform(_pairs, x -> array(x.`0`.`3`, x.`0`.`3` + 1, x.`0`.`3` + 2, x.`1`.`3`, x.`1`.`3` + 1, x.`1`.`3` + 2)))))").cast("long")).drop("_pairs")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts", "n_stop_words"]
    return counted.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        *names,
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_shouts", "n_words").alias("shout_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """For each rule a Boolean column: whether a document passes."""

    def passes(rule: Rule) -> Column:
        m = F.col(rule.measure)
        tests = [m >= F.lit(rule.least)] * (rule.least is not None) + [m <= F.lit(rule.most)] * (rule.most is not None)
        return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(True))

    return {rule.name: passes(rule) for rule in rules}


def judge(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, the measures, base_failed, kept, and the names of the rules that failed.

    A null text has no words, so it fails the base. Repeated rows give repeated rows; other columns
    are ignored unless named in `keep`; an empty table gives an empty result.
    """
    measured = measures(docs, id_col=id_col, text_col=text_col, keep=keep)
    tests = compiled(rules)
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return measured.select(
        "*",
        base_failed.alias("base_failed"),
        (~base_failed & reduce(Column.__and__, tests.values(), F.lit(True))).alias("kept"),
        F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests.items()], F.lit(None).cast("string"))).alias("failed_rules"),
    )


def kept_rows(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that are kept.

    A plain filter on `kept` would be pushed below the projections and so repeat every measure for
    every rule; the partition number in the filter's input keeps the filter where it is.
    """
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.struct("*").alias("_row"))
    judged = judge(rows, rules=rules, least_words=least_words, id_col="_key", text_col="_text", keep=("_row",))
    placed = judged.select("_row", "kept", F.spark_partition_id().alias("_part"))
    return placed.where("kept AND _part >= 0").select("_row.*")


def oracle(text_table: str = "documents") -> str:
    """DuckDB SQL for `judge` with the production table."""
    stops = ", ".join(f"'{w}'" for w in stop_forms())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {text_table}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w WHERE len(w) >= 3),
gg AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM g),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM gg) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + o.o) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) o(o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts,
        len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
        coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
v AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AS base_failed,
        word_chars / nullif(n_words, 0)::DOUBLE AS f1, n_symbols / nullif(n_words, 0)::DOUBLE AS f2,
        n_shouts / nullif(n_words, 0)::DOUBLE AS f3, n_stop_words / nullif(n_words, 0)::DOUBLE AS f4,
        n_dup_lines / nullif(n_lines, 0)::DOUBLE AS f5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce(f1 BETWEEN 2.0 AND 12.0, true) AND coalesce(f2 <= 0.1, true) AND coalesce(f3 <= 0.25, true)
   AND coalesce(f4 >= 0.06, true) AND coalesce(f5 <= 0.3, true)) AS kept
FROM v"""
