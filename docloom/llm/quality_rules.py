"""Quality rules: a threshold table compiled into one projection.

Each rule names a ratio, a bound and a limit. `measures` computes all ratios of a text with array functions of its own
row, so no text is exploded, shuffled or handed to Python; `compile_rules` turns the table into one boolean column.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he are this or from at an have "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les du un une que est pour qui dans par plus pas au sur ne avec en "
    "el y los se del las por con no su al lo como más es"
).split()


class Rule(NamedTuple):
    """measure >= limit (at_least) or measure <= limit."""

    measure: str
    at_least: bool
    limit: float


#: The base rules reject first; the others are the verdict on what they keep.
RULES = (
    Rule("mean_word_chars", True, 3.0),
    Rule("mean_word_chars", False, 10.0),
    Rule("symbols_per_word", False, 0.1),
    Rule("shouts_per_word", False, 0.5),
    Rule("letter_words", True, 0.7),
    Rule("upper_letters", False, 0.4),
    Rule("stop_words", True, 2.0),
    Rule("dup_line_ratio", False, 0.3),
    Rule("ellipsis_line_ratio", False, 0.3),
    Rule("bullet_line_ratio", False, 0.9),
)


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), and the counts that the rules need; df's columns may have any other name."""
    names = df.columns
    text = F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    empty = F.array().cast("array<string>")
    words = lambda x: F.when(trimmed == "", empty).otherwise(F.split(x, WORD_GAP))
    # Columns are numbered meanwhile, so that no name of df is one of ours.
    d = df.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("text", text).withColumn("words", words(trimmed))
    # A window of three words is known by its 64-bit hash within its own text.
    windows = F.transform(
        F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.withColumn("windows", windows).withColumn("lines", lines)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    paired = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), none).otherwise(paired))
    same = lambda x, k: F.coalesce(F.get("pairs", k)["h"] == x["h"], F.lit(False))
    starts = F.transform(F.filter("pairs", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    d = d.withColumn("starts", F.sort_array(starts))
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    n_lines = F.size("lines")
    found = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)),
        "n_dup_lines": n_lines - F.size(F.array_distinct("lines")),
        "n_repeat_words": covered,
        "n_lines": n_lines,
        "n_shouts": F.regexp_count("text", F.lit("!")),
        # Letters are counted by what is left without them, words with letters by one match each.
        "n_letters": F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", "")),
        "n_upper": F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", "")),
        "n_letter_words": F.regexp_count("text", F.lit(r"\p{L}[^\x20\x09-\x0D]*")),
        "n_stop_words": F.size(F.filter(words(F.lower(trimmed)), lambda w: w.isin(STOP_WORDS))),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
    }
    return d.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *(c.cast("long").alias(k) for k, c in found.items()))


def measures() -> dict[str, Column]:
    """The rules' ratios over the columns of with_counts(); an empty text has ratio 0."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "shouts_per_word": per("n_shouts", "n_words"),
        "letter_words": per("n_letter_words", "n_words"),
        "upper_letters": per("n_upper", "n_letters"),
        "stop_words": F.col("n_stop_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: all rules hold."""
    found, out = measures(), F.lit(True)
    for r in rules:
        out = out & ((found[r.measure] >= r.limit) if r.at_least else (found[r.measure] <= r.limit))
    return out


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """df with the counts, base_failed (under 50 words, or over half of the words in repeated windows) and kept.

    Null and empty texts have no words and fail; texts of any length are read whole. Each row is judged alone, so repeated rows and null ids are
    returned as they are; an empty table gives an empty result. Columns of df named like a count are replaced, others pass through.
    """
    own = [c for c in df.columns if c.lower() not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_letters", "n_upper", "n_letter_words", "n_stop_words", "n_ellipsis_lines", "n_bullet_lines", "base_failed", "kept")]
    counted = with_counts(df.select(*(f"`{c}`" for c in own)), text_col)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & compile_rules(rules))


def op6_threshold_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: DuckDB text of op6_threshold_rules; windows are compared as strings here.
OP6_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 2)) AS i,
         unnest(list_transform(generate_series(1, len(words) - 2), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) AS g
  FROM base WHERE len(words) >= 3),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM twice WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(3, coalesce(j - i, 3)))::BIGINT AS n FROM starts GROUP BY doc_id),
counts AS (
  SELECT base.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '!')) AS n_shouts,
         len(regexp_extract_all(text, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper,
         len(list_filter(words, lambda w: regexp_matches(w, '\\p{{L}}'))) AS n_letter_words,
         len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines
  FROM base LEFT JOIN repeats ON base.doc_id = repeats.doc_id),
failed AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND n_symbols <= 0.1 * n_words AND n_shouts <= 0.5 * n_words
       AND n_letter_words >= 0.7 * n_words AND n_upper <= 0.4 * n_letters AND n_stop_words >= 2
       AND n_dup_lines <= 0.3 * n_lines AND n_ellipsis_lines <= 0.3 * n_lines AND n_bullet_lines <= 0.9 * n_lines AS kept
FROM failed
"""
