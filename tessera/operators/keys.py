"""Digests of long keys and a membership map of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the map has 2 ** MAP_BITS bits (128 KB)
MAP_BITS = 20


def text_digest(text: Column) -> tuple[Column, ...]:
    """128 bits as two longs: hashes of the text with two seeds. Null has no digest."""
    return tuple(F.when(text.isNotNull(), h) for h in (F.xxhash64(text), F.xxhash64(F.lit("second"), text)))


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - MAP_BITS + 6).cast("int")


def _bit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - MAP_BITS).bitwiseAND(F.lit(63)).cast("int")


def membership_map(hashes: DataFrame) -> Column:
    """A lazy scalar: an array of longs with the bits of all hashes (the first column of ``hashes``) set.

    Map-side combined, so each task sends at most ``2 ** (MAP_BITS - 6)`` rows, however many hashes there are.
    """
    h = F.col(hashes.columns[0])
    words = hashes.where(h.isNotNull()).groupBy(_word(h).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h))).alias("b"))
    zero = hashes.sparkSession.range(1 << MAP_BITS - 6).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    dense = words.unionAll(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")).scalar()


def may_hold(bits: Column, h: Column) -> Column:
    """False only for hashes that are not in the map; null is not."""
    word = F.call_function("shiftrightunsigned", F.get(bits, _word(h)), _bit(h))
    return h.isNotNull() & (word.bitwiseAND(F.lit(1).cast("long")) == 1)
