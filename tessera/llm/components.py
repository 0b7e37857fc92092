"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and joins on the node; links are written to the shared
folder after each round. A node with very many links is aggregated map side and its
links are split by the adaptive skew join. The driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: each node hands its larger (or not larger) neighbours to its least one."""
    if large:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b); root is the least node reachable."""
    links = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        links = scratch.write(_star(_star(links, True), False), "links")
        row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (row["n"], row["h"])
    raise RuntimeError("components did not settle")
