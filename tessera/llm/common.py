"""Helpers shared by the training-data operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` everywhere.
Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir`` (every executor and the driver can read it), each run
in a folder of its own; nothing is written to a machine-local folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: the white space of all word and line rules
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Checkpoint folder of sessions that set none (tests, local runs).
LOCAL_SHARED_DIR = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a fixed folder in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = LOCAL_SHARED_DIR
    return path.rstrip("/")


class Scratch:
    """Tables of one run, written once under the shared folder and read again.

    A written table cuts the lineage and survives lost executors. The folder
    (``path``) belongs to the run; the caller may delete it when the results
    that read it have been consumed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def fresh_name(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of the input is called so."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def without_white_space(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE_SPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def words(text: Column) -> Column:
    """Array of words of ``text``; empty for null, empty or all-white texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_SPACE_RUN))


def with_row_id(docs: DataFrame) -> tuple[DataFrame, str]:
    """Adds a row number; the same one each time a stored table is read.

    The input must be a stored table (a file scan deals its rows to the same
    partitions in every run), as the pipeline's stages get.
    """
    rid = fresh_name(docs.columns, "row_id")
    return docs.withColumn(rid, F.monotonically_increasing_id()), rid


def keep_rows(docs: DataFrame, kept: DataFrame, rid: str) -> DataFrame:
    """The rows of ``docs`` (a stored table) whose row number is in ``kept``."""
    numbered, name = with_row_id(docs)
    return numbered.join(kept.select(F.col(rid).alias(name)), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 = 1; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def utf8(text) -> bytes:
    """The bytes of a text in a task; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def packed_texts(source: DataFrame) -> DataFrame:
    """row_id and the compressed UTF-8 bytes of ``text``, for shuffles that carry whole texts."""
    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pd.DataFrame({"row_id": pdf["row_id"], "packed": [z.compress(utf8(t)) for t in pdf["text"]]})

    return source.select("row_id", "text").mapInPandas(pack, "row_id long, packed binary")
