"""Quality rules: a table of thresholds, compiled into one Spark projection without user functions.

A rule names a measure, its bounds and why; a document is kept when no base check fails and every measure lies within its bounds.
Measures are lengths, symbols, stop words and line ratios of the whole text.

Defined cases: null text has no words and fails; an empty table gives an empty table; rows are judged one by one, so repeated rows are
judged alike; other columns pass through, and columns named like an output are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "are", "be", "at", "on", "by", "it", "or", "from", "was",
              "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "dans", "pour", "au", "ce", "se",
              "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "nicht", "sich", "auf", "im", "dem",
              "el", "los", "las", "y", "del", "por", "con", "una", "es", "no", "su", "lo")


@dataclass(frozen=True)
class Rule:
    name: str
    part: str                      # a measured column
    whole: str | None              # its divisor, or None for the number itself
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("words", "n_words", None, 20, 100_000),
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("alphabetic_words", "n_alphabetic", "n_words", 0.7, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _long(c: Column) -> Column:
    return c.cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of its texts; helper arrays are bound once below the projection that uses them."""
    named = docs.drop(*BASE, "n_lines", "n_stop_words", "n_alphabetic", "n_bullet_lines", "n_ellipsis_lines")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = named.withColumn("_words", F.array_remove(F.split(text, GAP), "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))))
    n = F.size("_words")
    # one hash for each window of words; most texts have no window twice and stop there
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    hashed = split.withColumn("_windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    # window and place, sorted: equal windows stand side by side
    pairs = F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    repeats = hashed.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs))
    near = lambda i, step: F.get("_sorted", i + step)["w"]
    twice = F.filter("_sorted", lambda s, i: s["w"].eqNullSafe(near(i, -1)) | s["w"].eqNullSafe(near(i, 1)))
    placed = repeats.withColumn("_places", F.array_sort(F.transform(twice, lambda s: s["i"])))
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")), lambda s: s["n"])
    lines = F.size("_lines")
    starts = lambda p: F.size(F.filter("_lines", lambda x: F.rlike(x, F.lit(p))))
    return placed.select(
        "*", _long(n).alias("n_words"), _long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        _long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"), _long(lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"), _long(lines).alias("n_lines"),
        _long(F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
        _long(F.size(F.filter("_words", lambda w: F.rlike(w, F.lit("\\p{L}"))))).alias("n_alphabetic"),
        starts("^[\\x20\\t]*[*\\u2022-]").alias("n_bullet_lines"), starts("(\\.\\.\\.|\\u2026)[\\x20\\t\\r]*$").alias("n_ellipsis_lines"),
    ).drop("_words", "_lines", "_windows", "_sorted", "_places")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition; a ratio over nothing is 0."""
    verdict = F.lit(True)
    for r in rules:
        value = F.col(r.part).cast("double")
        if r.whole:
            value = F.coalesce(F.try_divide(value, F.col(r.whole).cast("double")), F.lit(0.0))
        for bad in ([value < r.low] if r.low is not None else []) + ([value > r.high] if r.high is not None else []):
            verdict = verdict & ~bad
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, base_failed and kept."""
    few = F.col("n_words") < 20
    failed = few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured(docs.drop("base_failed", "kept")).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
