"""Lengths, length filters and dataset statistics.

Token counts (P16) come from a pluggable column function over the
rendered text. No tokenizer vocabulary ships with the library, so the
default is a regex token count (``\\w+`` runs and single symbols); a user
may pass any Column function, including an Arrow pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import is_number
from tessera.functions.text import col

TOKEN_RE = r"\w+|[^\w\s]"
# Same matches; the possessive run never backtracks (~15% faster on long texts).
_TOKEN_RE_JAVA = r"[\w]++|[^\w\s]"


def regex_tokens(c) -> Column:
    """Default length function: number of ``\\w+`` runs and non-space symbols."""
    return F.regexp_count(col(c), F.lit(_TOKEN_RE_JAVA))


def char_length(c) -> Column:
    return F.length(col(c))


_TOKENIZERS: dict = {}


def tokenizer_length(tokenizer_file: str, add_special_tokens: bool = True) -> Callable[[Column], Column]:
    """P16 with a real tokenizer: a ``tokenizer.json`` (Hugging Face ``tokenizers``
    format) counted in an Arrow UDF. The file is loaded once per worker
    process and each Arrow batch is encoded in one ``encode_batch`` call.
    The path must be readable from every executor (shared storage).
    """
    from pyspark.sql.types import IntegerType

    @F.pandas_udf(IntegerType())
    def _count(texts: pd.Series) -> pd.Series:
        tok = _TOKENIZERS.get(tokenizer_file)
        if tok is None:
            from tokenizers import Tokenizer
            tok = _TOKENIZERS[tokenizer_file] = Tokenizer.from_file(tokenizer_file)
        vals = texts.tolist()
        present = [i for i, t in enumerate(vals) if t is not None]
        counts = [None] * len(vals)
        if present:
            enc = tok.encode_batch([vals[i] for i in present], add_special_tokens=add_special_tokens)
            for i, e in zip(present, enc):
                counts[i] = len(e.ids)
        return pd.Series(counts, dtype="Int32")

    return lambda c: _count(col(c))


LENGTH_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "regex_tokens": regex_tokens,
    "chars": char_length,
}


def with_length(df: DataFrame, text: str = "text", out: str = "N",
                length_fn: Callable | str = "regex_tokens") -> DataFrame:
    """Add a length column computed from ``text``, once per row.

    The length comes from a generator of one element. Filters on it stay above, so they read the computed
    column instead of tokenizing again; filters and pruning of the other columns still go below, to the scan.
    """
    fn = LENGTH_FUNCTIONS[length_fn] if isinstance(length_fn, str) else length_fn
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select(*kept, F.explode(F.array(fn(F.col(text)).cast("int"))).alias(out))


def numeric_answer_filter(df: DataFrame, answer: str = "expected_answer") -> DataFrame:
    """Keep rows whose answer parses as a number (pandas rules)."""
    return df.where(is_number(answer))


def sft_max_length(max_seq_length: int = 2048, truncate_ratio: float = 0.5) -> int:
    """P11 threshold ``int(max_seq_length * truncate_ratio)`` (driver double)."""
    return int(max_seq_length * truncate_ratio)


def length_filter(df: DataFrame, n: str = "N", max_seq_length: int = 2048,
                  truncate_ratio: float = 0.5) -> DataFrame:
    """``N <= int(max_seq_length * truncate_ratio)``."""
    return df.where(F.col(n) <= F.lit(sft_max_length(max_seq_length, truncate_ratio)))


def window_filter(df: DataFrame, n: str = "N", max_seq_length: int = 2048) -> DataFrame:
    """Full-window filter ``N <= max_seq_length``."""
    return df.where(F.col(n) <= F.lit(max_seq_length))


def approx_length(a, b) -> Column:
    """Characters of exercise plus characters of solution."""
    return F.length(col(a)) + F.length(col(b))


def percentile_threshold(df: DataFrame, n: str = "prompt_length", p: float = 90) -> DataFrame:
    """A3: ``int(np.percentile(lengths, p))`` as a one-row DataFrame.

    ``percentile`` is exact (linear interpolation, like numpy); its buffer is
    a value->count map, bounded by the number of distinct lengths.
    """
    return df.agg(F.percentile(F.col(n), F.lit(p / 100.0)).cast("int").alias("max_prompt_length"))


def percentile_filter(df: DataFrame, n: str = "prompt_length", p: float = 90) -> DataFrame:
    """Keep ``n <= int(percentile(n, p))``; the threshold is a scalar subquery
    (one aggregate, then a filter), so no join and nothing collected."""
    thr = percentile_threshold(df, n, p).scalar()
    return df.where(F.col(n) <= thr)


def sequence_budget(threshold: DataFrame, max_seq_length: int = 2048, pad: int = 0) -> DataFrame:
    """``max_completion = max_seq_length - (max_prompt + pad)``; the
    notebook form uses ``pad=1``."""
    mp = F.col("max_prompt_length") + F.lit(pad)
    return threshold.select(mp.alias("max_prompt_length"),
                            (F.lit(max_seq_length) - mp).alias("max_completion_length"),
                            F.lit(max_seq_length).alias("max_seq_length"))


def length_stats(df: DataFrame, n: str = "N", by: Sequence[str] = ()) -> DataFrame:
    """A2: min / max / mean / exact median (optionally per group)."""
    return df.groupBy(*by).agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"),
                               F.avg(n).alias("mean_len"), F.median(n).alias("median_len"))


def retention_counts(df: DataFrame, keep: Column, by: Sequence[str] = ()) -> DataFrame:
    """A4: original / kept / removed counts in one pass."""
    return (df.groupBy(*by)
              .agg(F.count(F.lit(1)).alias("original"), F.count_if(keep).alias("kept"))
              .withColumn("removed", F.col("original") - F.col("kept")))


def training_plan(df: DataFrame, batch_size: int = 1, grad_accum: int = 4, epochs: int = 15,
                  sec_per_step_lo: float = 0.5, sec_per_step_hi: float = 1.0) -> DataFrame:
    """Steps per epoch, total steps and a time range, from one count."""
    n = F.count(F.lit(1))
    steps = F.floor(n / F.lit(batch_size * grad_accum)).cast("bigint")
    return df.agg(n.alias("examples"), steps.alias("steps_per_epoch"),
                  (steps * F.lit(epochs)).alias("total_steps"),
                  (steps * F.lit(epochs) * F.lit(sec_per_step_lo) / 60.0).alias("minutes_lo"),
                  (steps * F.lit(epochs) * F.lit(sec_per_step_hi) / 60.0).alias("minutes_hi"))


def require_non_empty(df: DataFrame, message: str = "No examples remain after filtering") -> DataFrame:
    """Opt-in guard (one ``limit 1`` job)."""
    if df.isEmpty():
        raise ValueError(message)
    return df
