"""Ranges of a sort order without a sort: bounds from a hash-drawn sample, rows placed by binary search.

Everything is lazy. The sample and the counts are scalar subqueries over the order columns only; since a hash draws the sample, the
bounds are the same whenever they are computed again, so plans that place the same rows twice agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sampled keys a range
SAMPLED = 20


def fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


class Ranges:
    """At most ``partitions + 1`` ranges of about equal size of the rows of ``df`` in ``order``; equal keys share a range."""

    def __init__(self, df: DataFrame, order: Sequence[str], partitions: int, column: str):
        self.order, self.column, self.partitions = list(order), column, max(1, partitions)
        p = self.partitions
        self.keys = df.select(self._key().alias("k"))
        n = self.keys.agg(F.count(F.lit(1)).alias("n")).scalar()
        # a key is drawn with the chance that gives SAMPLED keys a range; the hash falls in [0, 2 ** 53)
        drawn = F.shiftrightunsigned(F.xxhash64("k"), 11).cast("double") * n.cast("double") <= F.lit(2.0 ** 53 * SAMPLED * p)
        sample = self.keys.where(drawn).agg(F.sort_array(F.collect_list("k")).alias("s"))
        every = F.greatest(F.floor((F.size("s") + F.lit(p - 1)) / F.lit(p)).cast("int"), F.lit(1))
        self.bounds = sample.select(F.filter("s", lambda x, i: (i + 1) % every == 0).alias("s")).scalar()

    def _key(self) -> Column:
        return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(self.order)])

    def place(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Adds the number of the row's range: how many bounds are below its key. A binary search, one narrow projection a step."""
        k = fresh(df, "_k")
        placed, b, bounds = df.withColumn(k, F.col(key) if key else self._key()).withColumn(self.column, F.lit(0)), self.column, self.bounds
        for step in (1 << i for i in range(self.partitions.bit_length() - 1, -1, -1)):
            further = F.col(b) + step
            placed = placed.withColumn(b, F.when((further <= F.size(bounds)) & (F.get(bounds, further - 1) < F.col(k)), further).otherwise(F.col(b)))
        return placed.drop(k)

    def rows_before(self) -> Column:
        """How many rows the ranges before a placed row's range hold."""
        b = self.column
        counts = self.place(self.keys, "k").groupBy(b).agg(F.count(F.lit(1)).alias("n"))
        held = counts.agg(F.collect_list(F.struct(F.col(b).alias("r"), "n")).alias("c"), F.max(b).alias("last"))  # one entry a range
        before = held.select(F.transform(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))), lambda i: F.aggregate(
            F.filter("c", lambda x: x["r"] < i), F.lit(0).cast("long"), lambda total, x: total + x["n"])).alias("before")).scalar()
        return F.get(before, F.col(b))


def in_order(df: DataFrame, order: Sequence[str], partitions: int) -> DataFrame:
    """``df`` in ``order`` over ``partitions`` partitions, as ``orderBy`` leaves it, without the sampling pass over all columns.

    Range ``r`` goes to partition ``r``: it is dealt out by a number whose hash falls there, looked up among the first few numbers.
    """
    p = max(2, partitions)
    column = fresh(df, "_range")
    ranges = Ranges(df, order, p - 1, column)
    spark = df.sparkSession
    numbers = spark.range(40 * p).select(F.col("id").cast("int").alias("v")).select("v", F.pmod(F.hash("v"), F.lit(p)).alias("at"))
    found = {r["at"]: r["v"] for r in numbers.groupBy("at").agg(F.min("v").alias("v")).collect()}  # one entry a partition
    if len(found) < p:
        raise ValueError(f"no number falls into some of {p} partitions")
    dealt = F.array(*[F.lit(found[r]) for r in range(p)])
    placed = ranges.place(df).withColumn(column, F.get(dealt, F.col(column)))
    return placed.repartition(p, column).drop(column).sortWithinPartitions(*order)
