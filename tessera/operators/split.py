"""Top-k, remainders and exact-size splits.

The exact split (T3) orders rows by ``md5(seed || ':' || key)`` and keeps
the first ``int(n * ratio)``. Instead of a global sort it finds the boundary
hash by refining hex prefixes: each round counts rows per next-3-hex-digit
bucket (at most 4,096 counts reach the driver), keeps the bucket holding
the boundary and descends, until the bucket holds one row. Membership is a
plain predicate ``h <= h_k`` — no window over the data, independent of
partitioning, repeatable. A key repeated at the boundary raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def shortest_n(df: DataFrame, length: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` shortest rows (ties by key) -> TakeOrderedAndProject."""
    return df.orderBy(F.col(length).asc(), F.col(key).asc()).limit(n)


def remainder(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows not in ``taken`` (left anti join on the key; Spark chooses from runtime sizes)."""
    return df.join(taken.select(key), on=key, how="left_anti")


def shortest_split(df: DataFrame, length: str, key: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """test = ``n`` shortest, train = the rest."""
    test = shortest_n(df, length, key, n)
    return remainder(df, test, key), test


def split_hash(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _prefix_counts(cand: DataFrame, plen: int) -> list[tuple[str, int]]:
    pref = F.substring("_h", 1, plen)
    return sorted((r[0], r[1]) for r in cand.groupBy(pref.alias("_p")).count().collect())


def _boundary(cand: DataFrame, counts: list[tuple[str, int]], plen: int, k: int, digits: int) -> str:
    """Descend hex prefixes until the bucket holding the k-th row holds that row only."""
    while True:
        below = 0
        for cut, size in counts:
            if below + size >= k:
                break
            below += size
        else:
            raise ValueError("split size exceeds row count")
        k -= below
        cand = cand.where(F.substring("_h", 1, plen) == F.lit(cut))
        if size == 1:
            return cand.first()["_h"]
        if plen == 32:
            raise ValueError(f"{size} rows share the key at the split boundary: the key must be unique")
        plen = min(plen + digits, 32)
        counts = _prefix_counts(cand, plen)


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.select(split_hash(key, seed).alias("_h"))


def split_boundary(df: DataFrame, key: str, k: int, seed: int = 42, digits: int = 3) -> str | None:
    """The k-th smallest md5 hash of the keys (1-based); None when k <= 0."""
    if k <= 0:
        return None
    cand = _hashed(df, key, seed)
    return _boundary(cand, _prefix_counts(cand, digits), digits, k, digits)


def membership(df: DataFrame, key: str, train_ratio: float, seed: int, digits: int = 3) -> Column:
    """Train predicate for an exact ``int(n * ratio)`` split; the first prefix round
    also yields ``n`` (sum of bucket counts), so no separate count pass."""
    cand = _hashed(df, key, seed)
    counts = _prefix_counts(cand, digits)
    total = sum(c for _, c in counts)
    k = int(total * train_ratio)
    if k <= 0:
        return F.lit(False)
    if k >= total:
        return F.lit(True)
    return split_hash(key, seed) <= F.lit(_boundary(cand, counts, digits, k, digits))


def exact_split(df: DataFrame, key: str, train_ratio: float = 0.9, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Seeded split with exactly ``int(n * train_ratio)`` training rows.

    ``key`` must be unique; rows that share the key at the boundary raise. Row membership is not the reference's shuffle;
    size, determinism and completeness are the contract.
    """
    in_train = membership(df, key, train_ratio, seed)
    return df.where(in_train), df.where(~in_train)


def label_split(df: DataFrame, key: str, train_ratio: float = 0.9, seed: int = 42,
                out: str = "split") -> DataFrame:
    """T3 as one table with a ``train`` / ``test`` label column."""
    in_train = membership(df, key, train_ratio, seed)
    return df.withColumn(out, F.when(in_train, F.lit("train")).otherwise(F.lit("test")))


def split_summary(labelled: DataFrame, split: str = "split", length: str | None = None) -> DataFrame:
    """Size (and length range) per split side."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if length:
        aggs += [F.min(length).alias("min_len"), F.max(length).alias("max_len")]
    return labelled.groupBy(split).agg(*aggs)


def numbered_top(df: DataFrame, order: Sequence[str], n: int, out: str = "problem_number") -> DataFrame:
    """The first ``n`` rows, numbered from 1: a top-n, then its ``n`` rows gathered and unrolled."""
    top = df.orderBy(*order).limit(n)
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    gathered = top.agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return gathered.select(F.posexplode("_rows").alias("_pos", "_row")).select((F.col("_pos") + 1).cast("bigint").alias(out), "_row.*")


def point_lookup(numbered: DataFrame, idx: int, number: str = "problem_number") -> DataFrame:
    """T4: 0-based index into a numbered set, with a bounds check: a negative index raises at once,
    one beyond the end when the query runs."""
    if idx < 0:
        raise IndexError(f"Invalid index {idx}")
    one = numbered.where(F.col(number) == idx + 1).agg(F.first(F.struct("*")).alias("_row"))
    beyond = F.raise_error(F.lit(f"Invalid index {idx}")).cast("boolean")
    return one.where(F.when(F.col("_row").isNull(), beyond).otherwise(True)).select("_row.*")


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """T5: ordered head / listing."""
    return df.orderBy(*order).limit(n)
