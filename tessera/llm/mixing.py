"""Mixing sources to target weights.

Sizes are words. Sources are ordered by code point (null last) and weigh 1, 2, 3,
repeating; together they share 100 % of all words. A target stops at
``max_rate`` times its source's size, and the excess is shared again by weight among
the others until none is above: with the level L, a source's target is
min(max_rate * size, L * weight), and L rises round by round until the set of
capped sources no longer grows.

Each document is then taken floor(rate) times, plus one copy more with probability
rate - floor(rate), where rate = target / source size. The coin is the first 32 bits of
md5(seed, doc_id), so reruns agree on any cluster.

Plan: documents are reduced to (doc_id, source, size) once and written; per-source sums
are partial aggregates (a source with a third of all rows sends one row per task);
ranking the sources is a range partition with offsets, not one sorted task; each round
of the level is one aggregate over the source table, of which the driver gets three
numbers. The join of documents and sources is a broadcast if Spark finds the
source table small, else a skew-split join.

Defined results: null and empty texts have size 0 and are taken 0 times; a source without
words has target 0; a null source is a source of its own; rows with a null doc_id draw
their coin by their text; repeated rows draw the same coin; an empty table gives
no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix"


def ranked(sources: DataFrame, scratch: C.Scratch) -> DataFrame:
    """``rank`` 0, 1, ... of the rows by (no_source, source), without one sorted task."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(sources.repartitionByRange(n, "no_source", "source").withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("no_source", "source")) - 1
    return dealt.join(offsets, "part").withColumn("rank", within + F.col("offset")).drop("part", "offset")


def level(sources: DataFrame, max_rate: int) -> float | None:
    """The level L of the weights; None when no source is below its cap."""
    cap = max_rate * F.col("source_size")
    found, capped = 0.0, -1
    while True:
        over = F.lit(False) if capped < 0 else F.lit(found) * F.col("weight") > cap
        row = sources.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, cap).otherwise(0)).alias("capped"),
                          F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"), F.sum(over.cast("int")).alias("n")).first()
        if not row["weight"]:
            return None
        if row["n"] == capped:
            return found
        found, capped = (row["total"] - row["capped"]) / row["weight"], row["n"]


def coin(doc_id: Column, text_key: Column, seed: str) -> Column:
    """Uniform in [0, 1): 32 bits of md5(seed:doc_id)."""
    name = F.coalesce(doc_id.cast("string"), text_key)
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
          weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """row_id, doc_id, size, source_size, target, copies of each document."""
    scratch = C.Scratch(spark, "mixing")
    entries = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
                          F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    entries = entries.select("row_id", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
                             coin(F.col("doc_id"), F.coalesce(F.md5("text"), F.lit("")), seed).alias("coin"))
    entries = scratch.write(entries, "entries")
    sizes = entries.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("no_source", F.col("source").isNull())
    rank = ranked(sizes, scratch)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = scratch.write(rank.select("source", "source_size", weight.alias("weight")), "weights")
    found = level(sources, max_rate)
    cap = (max_rate * F.col("source_size")).cast("double")
    target = cap if found is None else F.least(cap, F.lit(found) * F.col("weight"))
    sources = sources.select(F.col("source").alias("name"), "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = entries.join(sources, F.col("source").eqNullSafe(F.col("name"))).withColumn("rate", rate)
    copies = F.floor("rate") + (F.col("coin") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("row_id", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mixture(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the document)."""
    return mixed(spark, docs, **options).select("doc_id", "size", "source_size", "target",
                                                (F.col("size") * F.col("copies")).alias("taken"))


def emit_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` (a stored table) as often as it is taken."""
    numbered, rid = C.with_row_id(docs)
    copies = fresh = C.fresh_name(numbered.columns, "copies")
    taken = mixed(spark, docs, **options).where("copies > 0").select(F.col("row_id").alias(rid), F.col("copies").cast("int").alias(copies))
    joined = numbered.join(taken, rid).withColumn(fresh, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
