"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct n-word shingles. Documents with equal
sets form one class; links are sought between classes, so thousands of copies cost one row.

1. *Order*. All shingles of all texts are counted in a sketch of fixed size (2**20
   counters); shingles are ordered by estimated frequency, rare ones first. Any order
   gives right results, the sketch only makes prefixes selective.
2. *Adaptive multi-match prefixes*. Two sets with Jaccard >= t share at least l tokens of their
   prefixes of length n - ceil(t n) + l, for every l. Each class takes the l = 1..MAX_MATCH
   that is expected to cost least: the classes met in the longer prefix, plus the verification
   of the candidates expected to remain. Its prefix goes to the token index; a pair is a
   candidate only if it shares min(l, l') tokens there and its sizes fit.
3. *Short lists*. The pairs of the classes in a token's list of at most ``LIST`` rows are counted
   by pair; that is at most ``LIST`` / 2 rows for a row of the index. Candidates are packed into
   units of bounded size that hold their texts.
4. *Long lists* (a family of near copies, a passage) are never paired up. A class gets an edge to
   the least class of its list and size band, and the least classes of neighbouring bands
   get one (sizes that fit are in the same or in neighbouring bands). No pair that shares a
   long list leaves a component of these edges, so these pairs need no count from step 3. A component
   is a unit; a larger one is cut into blocks, and each pair of blocks is a unit.
   Shared prefix tokens are counted within the unit.
5. *Verification* counts the whole intersection and compares
   100 * intersection >= percent * union in integers. A unit returns the links that connect its
   classes (a forest, linear in the classes); the forests are joined by connected components.

Shingles and tokens are 64-bit hashes, sets are equal if 128-bit digests are. A row of a class
stands for it, so classes cannot collide.

Defined results: null, empty and white texts have no shingles and link with nothing; their
component is their own doc_id. Null doc_ids count as larger than all others; a group whose
ids are all null has a null component. Repeated rows are one class. An empty table gives
no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import hashing as H
from tessera.llm.components import components

SKETCH_BITS = 20
MAX_MATCH = 16
LIST = 64
UNIT_CLASSES = 768
UNIT_BYTES = 12 << 20


def _sets(column: pd.Series, words: int) -> Iterator[np.ndarray]:
    for w in H.text_words([C.utf8(t) for t in column]):
        yield H.shingles(w, words)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """2**20 counters of the shingles of all texts; partial sums meet in a tree of two levels."""
    step, size = 1 << 12, 1 << SKETCH_BITS
    most = np.iinfo(np.uint32).max

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for pdf in batches:
            held, n = [], 0
            for s in _sets(pdf["text"], words):
                held.append(s)
                n += len(s)
                if n > size:
                    total += np.bincount(_bucket(np.concatenate(held)), minlength=size)
                    held, n = [], 0
            if n:
                total += np.bincount(_bucket(np.concatenate(held)), minlength=size)
        part = hash(total.tobytes()) % 64
        total = np.minimum(total, most).astype(np.uint32)
        yield pd.DataFrame([(k, part, total[k * step:(k + 1) * step].tobytes()) for k in range(size // step)], columns=["chunk", "part", "counts"])

    def add(key, pdf):
        total = np.zeros(step, dtype=np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint32)
        return pd.DataFrame([(*key, np.minimum(total, most).astype(np.uint32).tobytes())], columns=["chunk", "part"][:len(key)] + ["counts"])

    partial = docs.select("text").mapInPandas(count, "chunk int, part int, counts binary")
    partial = partial.groupBy("chunk", "part").applyInPandas(add, "chunk int, part int, counts binary")
    rows = partial.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()  # 4 MB whatever the input
    total = np.zeros(size, dtype=np.uint32)
    for r in rows:
        total[r["chunk"] * step:(r["chunk"] + 1) * step] = np.frombuffer(r["counts"], np.uint32)
    return total


def prefix_length(n: int, percent: int, match: int = 1) -> int:
    return min(n, n - -(-percent * n // 100) + match)


def in_order(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Tokens by estimated frequency, ties by value."""
    return tokens[np.lexsort((tokens, sketch[_bucket(tokens)]))]


def matches_wanted(ordered: np.ndarray, sketch: np.ndarray, percent: int) -> int:
    """The l that is expected to cost least.

    The prefix of l meets sum(frequency) classes; about one in 2**(l - 1) of those met
    by the first prefix is expected to share l tokens and to be verified at the cost of
    the whole set.
    """
    n = len(ordered)
    most = min(MAX_MATCH, -(-percent * n // 100))  # a prefix holds the whole set then
    reach = np.cumsum(sketch[_bucket(ordered[:prefix_length(n, percent, most)])].astype(np.float64))
    first = reach[prefix_length(n, percent) - 1]
    cost = [reach[prefix_length(n, percent, k) - 1] + first * n / 2 ** (k - 1) for k in range(1, most + 1)]
    return 1 + int(np.argmin(cost))


def matched_prefix(tokens: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """The l of a set and the prefix that goes with it."""
    ordered = in_order(tokens, sketch)
    match = matches_wanted(ordered, sketch, percent)
    return match, ordered[:prefix_length(len(ordered), percent, match)]


def _pairs_by_count(prefixes, need: np.ndarray) -> np.ndarray:
    """Codes i * len + j (i < j) of the classes that share min(need) prefix tokens."""
    d = len(prefixes)
    token, owner = np.concatenate(prefixes), np.repeat(np.arange(d), [len(p) for p in prefixes])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(head, len(token)))
    head, size = head[size > 1], size[size > 1]
    shared = np.zeros(d * d, dtype=np.uint32)
    while len(head):
        # the first members of the lists meet all later ones; then the second, and so on
        left = np.repeat(head, size - 1)
        step = np.arange(len(left)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + 1
        code = owner[left] * d + owner[left + step]
        uniq, n = np.unique(code, return_counts=True)
        shared[uniq] += n.astype(np.uint32)
        head, size = head + 1, size - 1
        head, size = head[size > 1], size[size > 1]
    found = np.flatnonzero(shared)
    return found[shared[found] >= np.minimum(need[found // d], need[found % d])]


def _candidates(prefixes, need: np.ndarray, n: np.ndarray, percent: int, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a unit's classes to verify; ``apart``: only pairs of two blocks."""
    if len(n) < 2:
        return n[:0], n[:0]
    code = _pairs_by_count(prefixes, need)
    i, j = code // len(n), code % len(n)
    fits = np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])
    if apart is not None:
        fits &= apart[i] != apart[j]
    return i[fits], j[fits]


def _forest(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs (i, j), links that connect what all links connect."""
    d, n = len(sets), np.array([len(s) for s in sets])
    parent = list(range(d))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    overlap = None
    if len(i) > 16 * d:  # many pairs: count all intersections at once
        token, owner = np.concatenate(sets), np.repeat(np.arange(d), n)
        uniq, at, count = np.unique(token, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        used = (count > 1)[at]
        at, owner = column[at[used]], owner[used]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        overlap = np.zeros((d, d), dtype=np.float32)
        for lo in range(0, int((count > 1).sum()), 2048):
            a, b = np.searchsorted(at, [lo, lo + 2048])
            m = np.zeros((d, 2048), dtype=np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            overlap += m @ m.T
        both = overlap[i, j].astype(np.int64)
        linked = both * 100 >= percent * (n[i] + n[j] - both)
        i, j = i[linked], j[linked]
    links = []
    for x, y in zip(i.tolist(), j.tolist()):
        if (a := root(x)) != (b := root(y)):
            if overlap is None:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both * 100 < percent * (n[x] + n[y] - both):
                    continue
            parent[max(a, b)] = min(a, b)
            links.append((x, y))
    return links


def jaccard_classes(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5,
                    percent: int = 80, scratch: C.Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): row_id, doc_id, n_shingles, class_id of every document, and class_id -> root of linked classes."""
    scratch = scratch or C.Scratch(spark, "jaccard-join")
    source = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
                         F.col(text).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(source, words))  # 4 MB whatever the input

    def describe(batches):
        for pdf in batches:
            out = []
            for rid, did, s in zip(pdf["row_id"], pdf["doc_id"], _sets(pdf["text"], words)):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                match, prefix = matched_prefix(s, sketch.value, percent) if len(s) else (0, s)
                out.append((rid, did, len(s), digest, match, prefix.tobytes()))
            yield pd.DataFrame(out, columns=["row_id", "doc_id", "n_shingles", "digest", "match", "prefix"]).astype({"doc_id": "Int64"})

    described = scratch.write(source.mapInPandas(describe, "row_id long, doc_id long, n_shingles long, digest binary, match int, prefix binary"), "sets")
    # a class is known by its first row
    classes = described.where("digest is not null").groupBy("digest").agg(F.min("row_id").alias("class_id"))
    classes = scratch.write(classes, "classes")
    rows = described.select("row_id", "doc_id", "n_shingles", "digest").join(classes, "digest", "left").drop("digest")
    members = described.select(F.col("row_id").alias("class_id"), "n_shingles", "match", "prefix").join(classes.select("class_id"), "class_id")
    width = math.log(100 / percent) * (1 + 1e-9)  # sizes that fit differ by less than one band

    def tokens(batches):
        for pdf in batches:
            if len(pdf):
                arrays = [np.frombuffer(p, np.int64) for p in pdf["prefix"]]
                n = [len(a) for a in arrays]
                yield pd.DataFrame({"token": np.concatenate(arrays), **{k: np.repeat(pdf[k].to_numpy(), n) for k in ("class_id", "n_shingles", "match")}})

    index = members.mapInPandas(tokens, "token long, class_id long, n_shingles long, match int")
    lists = index.groupBy("token").agg(F.count(F.lit(1)).alias("n_list")).where("n_list > 1")
    shared = scratch.write(index.join(lists, "token"), "shared")

    # short lists: pairs, counted
    short = shared.where(f"n_list <= {LIST}").select("token", "class_id", "n_shingles", "match")
    other = short.select("token", F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("match").alias("match_b"))
    fits = (F.least("n_shingles", "n_b") * 100 >= percent * F.greatest("n_shingles", "n_b")) & (F.col("class_id") < F.col("b"))
    pairs = short.join(other, "token").where(fits).groupBy(F.col("class_id").alias("a"), "b").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.least("match", "match_b")).alias("need"), F.first(F.col("n_shingles") + F.col("n_b")).alias("size"))
    pairs = scratch.write(pairs.where("n >= need").select("a", "b", "size"), "pairs")
    total = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes")).first()
    units = max(1, math.ceil((total["n"] or 0) / UNIT_CLASSES), math.ceil((total["bytes"] or 0) / UNIT_BYTES))
    unit = F.concat(F.lit("p"), F.pmod(F.xxhash64("a"), F.lit(units)).cast("string")).alias("unit")
    lists_of = pairs.groupBy("a").agg(F.collect_list("b").alias("partners"))  # each shares a short list with it
    none = F.lit(None).cast("array<bigint>")
    paired = lists_of.select(F.col("a").alias("row_id"), unit, "partners").unionAll(
        pairs.select(F.col("b").alias("row_id"), unit, none.alias("partners")).distinct())
    paired = paired.select("row_id", F.lit(0).alias("block"), F.lit(True).alias("own"), "unit", "partners")

    # long lists: components of the edges to the least classes
    long = shared.where(f"n_list > {LIST}").select("token", "class_id", "n_shingles", F.floor(F.log("n_shingles") / width).alias("band"))
    least = long.groupBy("token", "band").agg(F.min("class_id").alias("a"))
    above = least.select("token", (F.col("band") - 1).alias("band"), F.col("a").alias("b"))
    edges = long.join(least, ["token", "band"]).where("class_id <> a").select("a", F.col("class_id").alias("b"))
    edges = edges.unionAll(least.join(above, ["token", "band"]).select("a", "b")).distinct()
    near = components(edges, scratch)
    near = near.unionAll(near.select("root", "root").distinct())
    sized = scratch.write(near.join(long.select("class_id", "n_shingles").distinct(), near["node"] == F.col("class_id")).select("class_id", "root", "n_shingles"), "families")
    load = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    load = load.select("root", F.greatest(F.ceil(F.col("n") / UNIT_CLASSES), F.ceil(F.col("bytes") / UNIT_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    blocks = sized.join(load, "root").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.concat_ws(":", F.col("root").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    families = blocks.select(F.col("class_id").alias("row_id"), "block", (F.col("block") == F.col("other")).alias("own"), unit.alias("unit"), none.alias("partners"))
    dealt = paired.unionAll(families)

    def verify(key, pdf):
        z = zstandard.ZstdDecompressor()
        if key[0][0] == "p":
            wanted = {row: partners for row, partners in zip(pdf["row_id"], pdf["partners"]) if partners is not None}
            pdf = pdf.drop_duplicates("row_id")
        pdf = pdf.sort_values("row_id")
        ids = pdf["row_id"].to_numpy()
        held = [H.shingles(w, words) for w in H.text_words([z.decompress(p) for p in pdf["packed"]])]
        if key[0][0] == "p":
            at = {row: k for k, row in enumerate(ids.tolist())}
            ends = [(at[a], at[b]) for a, bs in wanted.items() for b in bs]
            i, j = np.array(ends, dtype=np.int64).reshape(-1, 2).T
        else:
            need, prefixes = zip(*(matched_prefix(s, sketch.value, percent) for s in held))
            i, j = _candidates(prefixes, np.array(need), np.array([len(s) for s in held]), percent, None if pdf["own"].all() else pdf["block"].to_numpy())
        return pd.DataFrame([(ids[x], ids[y]) for x, y in _forest(held, i, j, percent)], columns=["a", "b"])

    # the texts of the classes that have neighbours are read again; their sets are made where they are compared
    links = C.packed_texts(source).join(dealt, "row_id").groupBy("unit").applyInPandas(verify, "a long, b long")
    return rows, components(links, scratch)


def jaccard_join(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document."""
    rows, groups = jaccard_classes(spark, docs, **options)
    grouped = rows.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("group", F.coalesce("root", "class_id"))
    ids = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least_id"))
    out = grouped.join(ids, "group", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (a stored table) that stay: of each group the smallest doc_id, then the first row."""
    rows, groups = jaccard_classes(spark, docs, **options)
    grouped = rows.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("group", F.coalesce("root", "class_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("best")
    kept = grouped.where("group is not null").groupBy("group").agg(first).select(F.col("best.row_id").alias("row_id"))
    kept = kept.unionAll(grouped.where("group is null").select("row_id"))
    return C.keep_rows(docs, kept, "row_id")
