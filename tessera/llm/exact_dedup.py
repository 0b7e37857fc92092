"""Exact dedup with an extendible-hash index on shared files.

Texts are equal when they are identical after all white space is deleted.

1. *Entries*: one narrow row per document (row number, length, 64-bit key of the
   normalised text, its SHA-256), written to the shared folder.
2. *Directory*: a histogram of the first ``max_depth`` bits of the distinct keys, at most ``2 ** max_depth``
   numbers. Starting from one bucket, the directory doubles as long as some bucket holds more than ``capacity`` keys:
   each overfull bucket splits by one more bit. A bucket that is still overfull at ``max_depth`` keeps an overflow
   chain. The directory is an array of depths in the plan; a key finds its bucket by its slot.
3. *Copies*: each input task counts the equal texts it read, so a group that holds a third of all rows
   is one row per task.
4. *Owners*: these rows are dealt by bucket, so each owner task holds whole buckets. It compares
   the bytes of the texts of a bucket and a key, chains those that collide in the key but differ, and writes its part of the index.
5. *Lookup*: a document's entry goes to its bucket by the directory, there to its key, and along the chain to
   the record with its digest.

Of equal texts the row with the most code points in the original text, then the
smallest doc_id, stays; between rows that still tie, the first row number.

Defined results: a null text counts as empty, all empty texts are one group; a null
doc_id comes after all others; repeated rows are copies of each other (one
stays); an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

MAX_DEPTH = 14
CAPACITY = 1_000


def slot_of(key: Column, max_depth: int) -> Column:
    """The first bits of a key."""
    return F.shiftrightunsigned(key, 64 - max_depth).cast("int")


def doubled(fill: dict[int, int], capacity: int, max_depth: int) -> list[int]:
    """The depth of each slot's bucket: starting from one bucket, overfull ones split by a bit until they fit."""
    sums = [0]
    for slot in range(1 << max_depth):
        sums.append(sums[-1] + fill.get(slot, 0))
    depths = [0] * (1 << max_depth)
    overfull, depth = [0] if sums[-1] > capacity else [], 0
    while overfull and depth < max_depth:  # the directory doubles
        depth += 1
        size = 1 << max_depth - depth
        halves = [first + half for first in overfull for half in (0, size)]
        for first in halves:
            depths[first:first + size] = [depth] * size
        overfull = [first for first in halves if sums[first + size] - sums[first] > capacity]
    return depths


def depths_of(keys: DataFrame, capacity: int, max_depth: int) -> list[int]:
    """The directory for the keys in column ``key``; equal ones count once."""
    slots = keys.select("key").distinct().groupBy(slot_of(F.col("key"), max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return doubled({r["slot"]: r["n"] for r in slots.collect()}, capacity, max_depth)  # at most 2 ** max_depth rows


def placed(df: DataFrame, depths: list[int], max_depth: int) -> DataFrame:
    """Adds slot, depth and bucket (its first slot) of the key by the directory."""
    array = F.from_json(F.lit(str(depths)), "array<int>")  # folded to a constant
    found = df.withColumn("slot", slot_of(F.col("key"), max_depth)).withColumn("depth", F.get(array, F.col("slot")))
    return found.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)"))


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """slot -> (depth, bucket) for the slots of the keys in column ``key``."""
    return placed(keys.select("key"), depths_of(keys, capacity, max_depth), max_depth).select("slot", "depth", "bucket").distinct()


def build_index(spark: SparkSession, docs: DataFrame, scratch: C.Scratch, text: str = "text", doc_id: str = "doc_id",
                capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key=None):
    """(entries, index): the documents' narrow rows with their buckets, and the records of the index.

    ``key`` maps the normalised text to the 64-bit key (default xxhash64); a poor one
    only lengthens the chains.
    """
    key = key or F.xxhash64
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("row_id", F.monotonically_increasing_id())
    norm = C.without_white_space(F.col("text"))
    source = source.select("row_id", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_points"), norm.alias("norm"), F.spark_partition_id().alias("task"))
    source = source.withColumn("key", key(F.col("norm")))
    entries = scratch.write(source.select("row_id", "doc_id", "n_points", "key", F.sha2("norm", 256).alias("sha")), "entries")
    depths = depths_of(entries, capacity, max_depth)

    first = F.min(F.struct((-F.col("n_points")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    copies = source.groupBy("task", "key", "norm").agg(F.count(F.lit(1)).alias("n"), first.alias("best"))
    owned = placed(copies.drop("task"), depths, max_depth).repartition("bucket")
    records = owned.groupBy("bucket", "depth", "key", "norm").agg(F.sum("n").alias("n_rows"), F.min("best").alias("best"))
    chain = Window.partitionBy("bucket", "key").orderBy("sha")
    records = records.select("bucket", "depth", "key", F.sha2("norm", 256).alias("sha"), "n_rows", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"))
    index = scratch.write(records.withColumn("chain", F.row_number().over(chain)), "index")
    return placed(entries, depths, max_depth).drop("slot", "depth"), index


def lookup(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Each entry with its record: bucket, key, and along the chain the equal digest; a hot record's side is split by the adaptive skew join."""
    return entries.join(index.select("bucket", "key", "chain", "sha", "n_rows", "keep_id", "keep_row"), ["bucket", "key", "sha"])


def exact_dedup(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    entries, index = build_index(spark, docs, C.Scratch(spark, "exact-dedup"), text, doc_id, **options)
    found = lookup(entries, index)
    return found.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"),
                        (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (a stored table) that stay, with all their columns."""
    _, index = build_index(spark, docs, C.Scratch(spark, "exact-dedup"), **options)
    return C.keep_rows(docs, index, "keep_row")
