"""Suffix-array dedup: depth-limited radix sort of the suffixes of all texts.

Only the first ``length`` bytes of a suffix matter, so a suffix is sorted as its window
of ``length`` bytes. The sort works from the most significant digit on, and a group leaves
it as soon as it is decided: a group of one is no repeat; the equal groups
after the last digit are exactly the repeated windows.

Pass 1 (digit: ``ANCHOR`` bytes).  The first digit is content defined: of the substrings of
    ``ANCHOR`` bytes in a window, the one with the least hash (the leftmost of equal ones).
    Equal windows have equal first digits at equal offsets. Neighbouring windows share
    theirs, so a run of windows is one row (about one for 80 bytes of text). Rows are
    counted by digit with map-side pre-aggregation: a passage that a third of all texts
    share is one row per task. A digit that occurs once leaves the sort. A run whose
    whole content recurs leaves it too: all its windows are repeats.
Pass 2 (digit: all ``length`` bytes).  Undecided runs, and one run for each decided content of
    the same first digit, are sorted by (first digit, offset, window). First digits with up
    to ``HOT`` such runs are packed into units of bounded size and sorted there; the windows
    of more frequent ones are dealt out one by one, so no group is ever in one task.

Texts are compressed (zstandard) before each of the two shuffles that carry them. Digits are
compared by 64-bit hashes, each together with the one before it.

A byte is removed when a repeated window covers it. Defined results: a null text counts as
empty; texts shorter than ``length`` bytes keep every byte; matches never cross texts;
repeated rows are repeats of each other; a null doc_id is a document like any other;
an empty table gives no rows. Other columns are never read. The input must be a
stored table (rows are numbered in scan order, and read more than once).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import hashing as H

LENGTH = 200
ANCHOR = 40
HOT = 4096
UNIT_RUNS = 16_384
STEP = 1 << 18


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (leftmost of equal ones) in each window of ``width`` values."""
    n = len(h) - width + 1
    pad = -len(h) % width
    v = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]) if pad else h
    at = np.arange(len(v))
    grid, place = v.reshape(-1, width), at.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1)
    # running argmin from the left: the place where the minimum last fell
    fell = np.concatenate([np.ones((len(grid), 1), bool), ahead[:, 1:] < ahead[:, :-1]], axis=1)
    left_at = np.maximum.accumulate(np.where(fell, place, 0), axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)
    fell = np.concatenate([np.ones((len(grid), 1), bool), grid[:, ::-1][:, 1:] <= back[:, :-1]], axis=1)
    right_at = np.minimum.accumulate(np.where(fell, place[:, ::-1], np.iinfo(np.int64).max), axis=1)[:, ::-1].ravel()
    i = np.arange(n)
    a, b = right_at[i], left_at[i + width - 1]  # suffix minimum of one block, prefix minimum of the next
    return np.where(v[b] < v[a], b, a)


def runs(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, anchor position, least offset, greatest offset, content hash) of the runs of windows of a text.

    Worked off in steps of fixed size; a run that a step's end cuts is two runs.
    """
    for lo in range(0, max(0, len(data) - length + 1), STEP):
        buf = np.frombuffer(data, np.uint8, count=min(STEP + length - 1, len(data) - lo), offset=lo)
        s = H.running(buf)
        start = np.arange(len(buf) - ANCHOR + 1)
        h = H.spans(s, start, start + ANCHOR)
        at = _least(h, length - ANCHOR + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        anchor = at[first]
        yield h[anchor], anchor + lo, anchor - last, anchor - first, H.spans(s, first, last + length)


def _columns(names: str, arrays) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names.split(), arrays)))


def _runs_of_ones(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the maximal runs of true values within a group."""
    n = len(flag)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    opens = flag & (new | ~np.concatenate([[False], flag[:-1]]))
    closes = flag & np.concatenate([new[1:] | ~flag[1:], [True]]) if n else flag
    return np.flatnonzero(opens), np.flatnonzero(closes)


def _windows(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, key) of every window of the runs in ``pdf``; the key holds first digit, offset and content."""
    rows, offsets, keys = [], [], []
    contents, lows, anchors = pdf["content"].tolist(), pdf["low"].to_numpy(), pdf["anchor"].to_numpy().view(np.uint64)
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(contents):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP)))
        s = H.running(np.frombuffer(b"".join(contents[at:to]), np.uint8))
        base = np.cumsum(sizes[at:to]) - sizes[at:to]
        count = sizes[at:to] - length + 1
        row = np.repeat(np.arange(at, to), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = base[row - at] + k
        offset = lows[row] + count[row - at] - 1 - k  # the first window has the greatest offset
        h = H.spans(s, start, start + length)
        rows.append(row)
        offsets.append(offset)
        keys.append(H.mix(h + H.mix(anchors[row] + offset.astype(np.uint64))))
        at = to
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(keys)


def repeated_spans(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(source, starts): row_id, doc_id and text of the documents; row_id, first and last start of runs of repeated windows."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    scratch = C.Scratch(spark, "suffix-dedup")
    source = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def first_digit(batches):
        for pdf in batches:
            rows = []
            for rid, t in zip(pdf["row_id"], pdf["text"]):
                data = C.utf8(t)
                for anchor, at, low, high, whole in runs(data, length):
                    rows.append((np.full(len(at), rid), at, low * 65536 + high, anchor.view(np.int64), whole.view(np.int64)))
            if rows:
                yield _columns("row_id at span anchor whole", [np.concatenate(x) for x in zip(*rows)])

    digits = source.select("row_id", "text").mapInPandas(first_digit, "row_id long, at long, span long, anchor long, whole long")
    variants = digits.groupBy("anchor", "span", "whole").agg(F.count(F.lit(1)).alias("n"))
    per_anchor = variants.groupBy("anchor").agg(F.sum("n").alias("n_runs"), F.count(F.lit(1)).alias("n_contents"), F.sum((F.col("n") == 1).cast("int")).alias("n_open")).where("n_runs > 1")
    kept = variants.join(per_anchor, "anchor").select("anchor", "span", "whole", (F.col("n") > 1).alias("equal"),
                                                      (F.col("n_open") > 0).alias("open"), (F.col("n_contents") > HOT).alias("hot"))
    kept = scratch.write(kept, "groups")
    low, high = F.shiftright("span", 16).alias("low"), F.col("span").bitwiseAND(65535).alias("high")
    found = digits.join(kept, ["anchor", "span", "whole"]).select("row_id", "at", low, high, "anchor", "whole", "equal", "open", "hot")
    found = scratch.write(found, "runs")
    decided = found.where("equal").select("row_id", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"))
    samples = found.where("equal and open").groupBy("anchor", "low", "high", "whole", "hot").agg(F.min(F.struct("row_id", "at")).alias("one"))
    names = ["row_id", "at", "low", "high", "anchor", "hot", "equal"]
    undecided = found.where("not equal").select(*names).unionAll(
        samples.select("one.row_id", "one.at", "low", "high", "anchor", "hot", F.lit(True).alias("equal")))
    undecided = scratch.write(undecided, "undecided")

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for rid, packed, todo in zip(pdf["row_id"], pdf["packed"], pdf["todo"]):
                data = z.decompress(packed)
                for r in todo:
                    rows.append((rid, r["at"], r["low"], r["high"], r["anchor"], r["hot"], r["equal"], data[r["at"] - r["high"]:r["at"] - r["low"] + length]))
            if rows:
                yield pd.DataFrame(rows, columns=[*names, "content"])

    todo = undecided.groupBy("row_id").agg(F.collect_list(F.struct(*names[1:])).alias("todo"))  # at most a run for each byte of one text
    kinds = "row_id long, at long, low long, high long, anchor long, hot boolean, equal boolean, content binary"
    contents = C.packed_texts(source).join(todo, "row_id").mapInPandas(cut, kinds)
    contents = scratch.write(contents, "contents")

    def sort_unit(pdf):
        row, offset, key = _windows(pdf, length)
        equal = pdf["equal"].to_numpy()
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        also = np.zeros(len(count), dtype=bool)
        also[at[equal[row]]] = True
        repeat = ((count > 1) | also)[at] & ~equal[row]
        first, last = _runs_of_ones(repeat, row)
        place = pdf["at"].to_numpy()
        return _columns("row_id first last", [pdf["row_id"].to_numpy()[row[first]], place[row[first]] - offset[first], place[row[last]] - offset[last]])

    n = contents.where("not hot").count()
    unit = F.pmod(F.xxhash64("anchor"), F.lit(max(1, math.ceil(n / UNIT_RUNS))))
    spans = "row_id long, first long, last long"
    cold = contents.where("not hot").withColumn("unit", unit).groupBy("unit").applyInPandas(sort_unit, spans)

    def deal(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo:lo + 2048].reset_index(drop=True)
                row, offset, key = _windows(part, length)
                yield _columns("row_id start equal key", [part["row_id"].to_numpy()[row], part["at"].to_numpy()[row] - offset, part["equal"].to_numpy()[row], key.view(np.int64)])

    dealt = contents.where("hot").mapInPandas(deal, "row_id long, start long, equal boolean, key long")
    often = dealt.groupBy("key").agg(F.sum(F.when(F.col("equal"), 2).otherwise(1)).alias("n")).where("n > 1").select("key")
    hot = dealt.where("not equal").join(often, "key").select("row_id", F.col("start").alias("first"), F.col("start").alias("last"))
    return source, decided.unionAll(cold).unionAll(hot)


def removed(starts, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal [from, to) that the windows at the given runs of starts cover."""
    out: list[list[int]] = []
    for first, last in sorted(starts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, min(b, size)) for a, b in out]


def dedup_texts(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """row_id, n_bytes, spans (removed [from, to) byte ranges) and kept (remaining bytes) of each document."""
    source, starts = repeated_spans(spark, docs, text, doc_id, length)
    starts = starts.groupBy("row_id").agg(F.collect_list(F.struct("first", "last")).alias("starts"))  # of one text
    joined = C.packed_texts(source).join(starts, "row_id", "left")

    def strip(batches):
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for rid, packed, found in zip(pdf["row_id"], pdf["packed"], pdf["starts"]):
                data = z.decompress(packed)
                spans = removed([(r["first"], r["last"]) for r in found], length, len(data)) if found is not None else []
                edges = [0, *[x for s in spans for x in s], len(data)]
                rows.append((rid, len(data), [{"from": a, "to": b} for a, b in spans], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            yield pd.DataFrame(rows, columns=["row_id", "n_bytes", "spans", "kept"])

    return joined.mapInPandas(strip, "row_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")


def suffix_dedup(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    cleaned = dedup_texts(spark, docs, text, doc_id, length)
    sizes = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    digest = cleaned.select("row_id", "n_bytes", sizes.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    ids = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"))
    return ids.join(digest, "row_id").drop("row_id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
