"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the whole text; the table RULES compares
100 * numerator with bounds times the denominator, all in integers. The
measures are staged projections of one scan (each later stage refers to the word and
line arrays by name), so there is no shuffle, no join and no user function.

Words in repeated windows: the 64-bit hashes of the 3-word windows are sorted with their
positions; equal neighbours are repeated windows, and the words that the sorted
positions cover are counted. Sorting keeps this n log n however often a window recurs.
Two different windows of one text are taken for equal with probability 2**-64 a pair.

Defined results: null, empty and white texts have no words, fail the base rule and are not
kept; repeated rows give repeated results; an empty table gives no rows. Other columns
are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: fixed values: the most frequent function words of English, German, French and Spanish
STOP_WORDS = ("the of and to a in is that it for on with as was be by are this from at or an not "
              "der die und das den dem ein eine von zu mit sich auf für ist im nicht als auch es "
              "de la le les des et un une du que en est pour dans par sur au avec qui pas "
              "el los las del y se lo con para una al su como más").split()

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """low <= 100 * numerator / denominator <= high; None: no bound."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


RULES = (
    Rule("length", "n_words", "one", 100 * MIN_WORDS, 100 * 1_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 200, 1_500),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("exclamations", "n_bangs", "n_words", None, 50),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
)


def verdict(rules: tuple[Rule, ...], column=F.col) -> Column:
    """All rules as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        value, base = column(r.numerator) * 100, F.lit(1) if r.denominator == "one" else column(r.denominator)
        if r.low is not None:
            out = out & (value >= base * r.low)
        if r.high is not None:
            out = out & (value <= base * r.high)
    return out


def covered_words(words: Column, n: Column) -> Column:
    """Words that lie in a window found at least twice."""
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW),
                         lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
    return F.when(n <= WINDOW, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.array_sort(hashes))


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and all measures of each document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.select("doc_id", C.words(F.col("text")).alias("words"),
                           F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(C.WHITE_SPACE)) != "").alias("lines"),
                           F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                           F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"))
    source = source.withColumn("n", F.size("words"))
    source = source.select("doc_id", "n", "n_symbols", "n_bangs", F.size("lines").cast("long").alias("n_lines"),
                           (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                           F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
                           F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                           covered_words(F.col("words"), F.col("n")).alias("windows"))
    near = lambda w, k: F.coalesce(F.get(F.col("windows"), k)["h"] == w["h"], F.lit(False))
    same = F.filter("windows", lambda w, k: near(w, k - 1) | near(w, k + 1))
    source = source.withColumn("at", F.array_sort(F.transform(same, lambda w: w["i"])))
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
                          lambda s: s["n"])
    return source.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                         covered.alias("n_repeat_words"), "n_lines", "n_stop_words", "n_bangs")


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base_failed and kept of each document."""
    measured = measure(docs, text, doc_id)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (measured.withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))
