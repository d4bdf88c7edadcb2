"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over the whole text; no user function
runs.  ``RULES`` names a measure and the closed interval it must lie in; the
table is compiled to one boolean column per rule plus the verdict.

Defined cases: a null text counts as empty (no words, no lines); a ratio over
zero words or lines is 0; a very long text is judged whole, in one row; a text
in a language other than English, German, French and Spanish has no stop words
of the list and is not kept; repeated rows are judged one by one; an empty
table gives an empty result; other columns of the input are ignored, whatever their
names are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, q

# FIXED VALUES: the symbols that the contract counts
SYMBOLS = "#*$%&|<>"

# FIXED VALUES: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht eine ein als "
    "de la le et les en un du une que pour est dans qui par au sur pas avec "
    "el y los se las del por con no su para al lo"
).split()

MIN_WORDS = 50            # base rule: fewer words fail
MAX_REPEAT_PERCENT = 50   # base rule: more words in repeated 3-word windows fail
_POSITION_BITS = 31       # a Spark array holds fewer than 2**31 words


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; None leaves that side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=MIN_WORDS),
    Rule("word_length", "mean_word_chars", low=2.5, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.4),
    Rule("repetition", "repeat_word_ratio", high=MAX_REPEAT_PERCENT / 100),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts and ratios that rules may name.

    Words in repeated windows: each 3-word window is packed as 33 bits of its
    hash over its position, the packed longs are sorted, and windows whose hash
    has an equal neighbour are candidates (a superset).  Only candidates are
    compared as text, so the count is exact and takes n log n per document.
    """
    text = F.coalesce(q(text_col).cast("string"), F.lit(""))
    df = docs.select(q(id_col).alias("doc_id"), text.alias("_text"))
    no_symbols = F.col("_text")
    for s in SYMBOLS:
        no_symbols = F.replace(no_symbols, F.lit(s), F.lit(""))
    df = df.select(
        "doc_id", "_text",
        F.filter(F.split("_text", SPACE_CLASS + "+", -1), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
        (F.octet_length("_text") - F.octet_length(no_symbols)).cast("long").alias("n_symbols"),
    )
    mask = (1 << _POSITION_BITS) - 1
    word = lambda i: F.get(F.col("_words"), i)
    windows = F.when(F.size("_words") > 2, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(
        F.array().cast("array<int>"))
    df = df.select(
        "doc_id", "n_symbols", "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.sort_array(F.transform(windows, lambda i: F.shiftleft(
            F.xxhash64(word(i), word(i + 1), word(i + 2)), _POSITION_BITS).bitwiseOR(i.cast("long")))).alias("_packed"),
    )
    high = lambda x: F.shiftright(x, _POSITION_BITS)
    near = lambda a, i, f: F.coalesce(f(F.get(a, i)), F.lit(False))
    packed = F.col("_packed")
    df = df.withColumn("_maybe", F.filter(packed, lambda x, i: near(packed, i - 1, lambda y: high(y) == high(x))
                                          | near(packed, i + 1, lambda y: high(y) == high(x))))
    df = df.withColumn("_grams", F.sort_array(F.transform("_maybe", lambda x: F.struct(
        F.concat_ws(" ", word(x.bitwiseAND(mask).cast("int")), word(x.bitwiseAND(mask).cast("int") + 1),
                    word(x.bitwiseAND(mask).cast("int") + 2)).alias("g"),
        x.bitwiseAND(mask).cast("int").alias("p")))))
    grams = F.col("_grams")
    again = F.filter(grams, lambda s, i: near(grams, i - 1, lambda y: y["g"] == s["g"])
                     | near(grams, i + 1, lambda y: y["g"] == s["g"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda s: F.array(s["p"], s["p"] + 1, s["p"] + 2))))
    # the condition always holds: it only keeps later filters from being pushed into (and repeating) the steps above
    repeats = F.when(F.spark_partition_id() >= 0, F.size(covered).cast("long"))
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words",
                   repeats.alias("n_repeat_words"))
    return df.select(
        "*",
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> list[Column]:
    """One boolean column ``pass_<rule>`` per row of the threshold table."""
    out = []
    for r in rules:
        x = F.col(r.measure)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (x >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (x <= F.lit(r.high))
        out.append(ok.alias(f"pass_{r.name}"))
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Measures, one ``pass_*`` column per rule, ``base_failed`` and ``kept`` for every document."""
    m = measures(docs, id_col, text_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = m.select("*", base.alias("base_failed"), *compile_rules(rules))
    verdict = ~F.col("base_failed")
    for r in rules:
        verdict = verdict & F.col(f"pass_{r.name}")
    return judged.withColumn("kept", verdict)
