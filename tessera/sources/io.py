"""Readers and writers.

Readers declare schemas (no inference); writers stay distributed: every
result set is written by many tasks as Parquet / JSON Lines / CSV parts.
One-document comparison JSON is read, not written: that format needs one task.
"""

from __future__ import annotations

import datetime as _dt
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.text import slug
from tessera.operators.messages import require_columns
from tessera.session import checkpoint_dir

SFT_COLUMNS = ("expected_answer", "problem", "generated_solution")

EXERCISE_SCHEMA = T.StructType([
    T.StructField("exercise_number", T.StringType()),
    T.StructField("exercise_text", T.StringType()),
    T.StructField("solution_text", T.StringType()),
])

FORMAT_CHECK = T.StructType([
    T.StructField("has_reasoning_end", T.BooleanType()),
    T.StructField("has_solution_start", T.BooleanType()),
    T.StructField("has_solution_end", T.BooleanType()),
    T.StructField("format_ok", T.BooleanType()),
])
_MODEL_RESULT = T.StructType([T.StructField("response", T.StringType()),
                              T.StructField("format_check", FORMAT_CHECK)])
SINGLE_SCHEMA = T.StructType([T.StructField("problem_id", T.LongType()), T.StructField("problem", T.StringType()),
                              *_MODEL_RESULT.fields])
COMPARISON_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("timestamp", T.StringType()), T.StructField("base_model", T.StringType()),
        T.StructField("sft_model", T.StringType()), T.StructField("num_problems", T.LongType())])),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("problem_id", T.LongType()), T.StructField("problem", T.StringType()),
        T.StructField("base_model", _MODEL_RESULT), T.StructField("sft_model", _MODEL_RESULT)]))),
    T.StructField("summary", T.StructType([
        T.StructField("base_model_correct", T.LongType()), T.StructField("sft_model_correct", T.LongType()),
        T.StructField("base_model_accuracy", T.DoubleType()),
        T.StructField("sft_model_accuracy", T.DoubleType()),
        T.StructField("improvement", T.LongType())])),
])


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | None = None):
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r


def load_sft(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the SFT table and keep its three columns (pruned at the scan)."""
    df = _reader(spark, fmt).load(path)
    return require_columns(df, SFT_COLUMNS, "SFT dataset").select(*SFT_COLUMNS)


def load_rl(spark: SparkSession, path: str, config: str | None = None, split: str | None = None,
            fmt: str = "parquet") -> DataFrame:
    """Read the RL prompt table; ``config``/``split`` become partition filters."""
    df = _reader(spark, fmt).load(path)
    for name, value in (("config", config), ("split", split)):
        if value is not None:
            df = require_columns(df, (name,), "RL dataset").where(F.col(name) == value)
    return require_columns(df, ("prompt",), "RL dataset")


def read_exercises(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON Lines exercises with an explicit schema and a line order column.

    ``line_no`` orders rows as they appear (file path, block of the file, position); it
    backs the last-wins lookup (S4). Spark orders its scan partitions by size, so the row
    number alone is no file order.
    """
    df = spark.read.schema(EXERCISE_SCHEMA).json(path)
    return df.withColumn("line_no", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                             F.monotonically_increasing_id().alias("row")))


def read_exercise_lines(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """S3: JSON Lines exercises with ``file`` and the true ``line_no`` (from 1, blank lines counted) of each row.

    With ``in_parts`` a folder is one file in parts, as several tasks write it: ``file`` is the folder, lines are numbered
    through its files in name order.

    A two-pass prefix sum: each split counts its lines, the counts before a split in its file (a file has as many counts as splits) are broadcast back,
    and a line's place in its split is added. No job runs while the query is built, no file is read whole by one task.
    """
    meta = [F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    file = F.regexp_replace("part", "/[^/]*$", "") if in_parts else F.col("part")
    splits = splits.groupBy(file.alias("file")).agg(F.sort_array(F.collect_list(F.struct("part", "block", "n", "first"))).alias("s"))
    before = F.transform("s", lambda x, i: F.struct(x["part"].alias("part"), x["block"].alias("block"), x["first"].alias("first"), F.aggregate(
        F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda total, y: total + y["n"]).alias("before")))
    starts = splits.select("file", F.inline(before))
    placed = lines.join(F.broadcast(starts), ["part", "block"]).withColumn("line_no", F.col("before") + F.col("row") - F.col("first") + 1)
    record = F.from_json("value", EXERCISE_SCHEMA)
    return placed.where(F.btrim("value") != "").select(record.alias("r"), "file", "line_no").select("r.*", "file", "line_no")


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """Comparison results -> long table ``(problem_id, model, ...)``.

    Reads the distributed layout (``results/`` and one-row ``metadata/``) or one JSON document
    with ``metadata`` and ``results``; a document without ``results`` raises.
    """
    try:
        lines = spark.read.schema(COMPARISON_SCHEMA["results"].dataType.elementType).json(f"{path.rstrip('/')}/results")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        doc = spark.read.schema(COMPARISON_SCHEMA).option("multiLine", True).json(path)
        results = F.coalesce(F.col("results"), F.raise_error(F.lit("no results in the comparison file")))
        ex = doc.select(F.col("metadata.base_model").alias("base_name"),
                        F.col("metadata.sft_model").alias("sft_name"),
                        F.posexplode(results).alias("pos", "r"))
    else:
        names = spark.read.schema("base_model string, sft_model string").json(f"{path.rstrip('/')}/metadata")
        one = names.first()  # the layout's one row
        ex = lines.select(F.lit(one.base_model).alias("base_name"), F.lit(one.sft_model).alias("sft_name"),
                          F.lit(None).cast("int").alias("pos"), F.struct("*").alias("r"))
    pid = F.coalesce(F.col("r.problem_id"), F.col("pos") + 1)
    base = ex.select(pid.alias("problem_id"), F.col("r.problem").alias("problem"),
                     F.lit("base").alias("model"), F.col("base_name").alias("model_name"),
                     F.col("r.base_model.response").alias("response"),
                     F.col("r.base_model.format_check").alias("format_check"))
    tuned = ex.select(pid.alias("problem_id"), F.col("r.problem").alias("problem"),
                      F.lit("tuned").alias("model"), F.col("sft_name").alias("model_name"),
                      F.col("r.sft_model.response").alias("response"),
                      F.col("r.sft_model.format_check").alias("format_check"))
    return base.unionByName(tuned)


def write_comparison(pairs: DataFrame, summary: DataFrame, path: str, base_name: str,
                     sft_name: str, timestamp: str | None = None) -> None:
    """Comparison results.

    The layout is distributed: ``results/`` (JSON Lines, one problem per
    line, same nested shape as the reference's ``results[]``), ``metadata/``
    and ``summary/`` (one row each). The three replace older ones together (:func:`write_together`).
    """
    ts = timestamp or _dt.datetime.now().isoformat()
    res = pairs.select(
        F.col("problem_id"), F.col("problem"),
        F.struct(F.col("base_response").alias("response"),
                 F.col("base_format_check").alias("format_check")).alias("base_model"),
        F.struct(F.col("sft_response").alias("response"),
                 F.col("sft_format_check").alias("format_check")).alias("sft_model"))
    summ = summary.select("base_model_correct", "sft_model_correct", "base_model_accuracy",
                          "sft_model_accuracy", "improvement")
    write_together(path, {"results": res, "summary": summ, "metadata": _metadata(summary, timestamp=ts, base_model=base_name, sft_model=sft_name)})


def _metadata(summary: DataFrame, **values: str | None) -> DataFrame:
    """One row: the values and the number of problems, taken from the summary."""
    return summary.select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()], F.col("num_problems").cast("long"))


def write_together(path: str, tables: dict[str, DataFrame]) -> None:
    """Write tables as JSON Lines folders under ``path`` that replace older ones together.

    All are written to a staging folder first; only when the last one is complete do they move into place, by renames of the file
    system that Spark writes to. A run that fails leaves the old folders as they were; a failed move is undone.
    """
    spark = next(iter(tables.values())).sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root, run = path.rstrip("/"), uuid.uuid4().hex
    staged, replaced = f"{root}/_staged-{run}", f"{root}/_replaced-{run}"

    def move(source: str, target: str) -> None:
        if not fs.rename(Path(source), Path(target)):
            raise OSError(f"could not move {source} to {target}")

    moved: list[tuple[str, str]] = []
    try:
        for name, df in tables.items():
            df.write.json(f"{staged}/{name}")
        fs.mkdirs(Path(replaced))
        for name in tables:
            if fs.exists(Path(f"{root}/{name}")):
                move(f"{root}/{name}", f"{replaced}/{name}")
                moved.append((f"{replaced}/{name}", f"{root}/{name}"))
        for name in tables:
            move(f"{staged}/{name}", f"{root}/{name}")
            moved.append((f"{root}/{name}", f"{staged}/{name}"))
    except BaseException:
        for source, target in reversed(moved):
            fs.rename(Path(source), Path(target))
        raise
    finally:
        for folder in (staged, replaced):
            fs.delete(Path(folder), True)


def write_single_model(results: DataFrame, summary: DataFrame, path: str, model_name: str,
                       model_type: str | None = None, timestamp: str | None = None) -> None:
    """Single-model results (JSON Lines results + one-row metadata/summary)."""
    ts = timestamp or _dt.datetime.now().isoformat()
    rows = results.select("problem_id", "problem", "response", "format_check")
    write_together(path, {"results": rows, "summary": summary, "metadata": _metadata(summary, timestamp=ts, model_name=model_name, model_type=model_type)})


def read_single_model(spark: SparkSession, path: str) -> DataFrame:
    """S7 back: ``(problem_id, problem, response, format_check, model_name, model_type)``."""
    rows = spark.read.schema(SINGLE_SCHEMA).json(f"{path.rstrip('/')}/results")
    one = spark.read.schema("model_name string, model_type string").json(f"{path.rstrip('/')}/metadata").first()  # the layout's one row
    return rows.withColumns({"model_name": F.lit(one.model_name), "model_type": F.lit(one.model_type)})


def write_judged_csv(judged: DataFrame, path: str) -> None:
    """Judged rows as CSV with header; multi-line text is quoted, white space at its ends is kept."""
    (judged.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, record: the records of quoted CSV files with a header each, read by as many tasks as there are splits.

    A line ends a record if the quotation marks up to it are even. Each split counts its marks; the parity of all splits before it
    (a prefix sum over one number a split) tells its first line whether it stands inside a record. Tasks then join lines in one pass
    over their splits. What a split boundary cuts (two pieces a split at most) is put together by a window over these pieces.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*meta, "value")
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg(F.pmod(F.sum(marks), F.lit(2)).alias("odd"))
    splits = splits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "odd"))).alias("s"))
    starts = splits.select("file", F.inline(F.transform("s", lambda x, i: F.struct(x["block"].alias("block"), F.pmod(F.aggregate(
        F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda total, y: total + y["odd"]), F.lit(2)).alias("odd")))))
    # only splits that begin inside a record: one row of two numbers and a path each
    inside = starts.where("odd = 1").select("file", "block", F.lit(True).alias("inside"))
    placed = lines.join(F.broadcast(inside), ["file", "block"], "left").select("file", "block", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    columns = ["file", "block", "place", "kind", "record"]

    def joined(batches):
        state: dict = {"split": None}

        def close(out):
            if state["split"] is not None and state["held"]:
                out.append((*state["split"], state["place"], "middle" if state["tail"] else "head", "\n".join(state["held"])))

        for batch in batches:
            out: list = []
            for file, block, value, begun in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != state["split"]:
                    close(out)
                    state = {"split": (file, block), "place": 0, "held": [], "open": begun, "tail": begun}
                state["held"].append(value)
                if value.count('"') % 2:
                    state["open"] = not state["open"]
                if not state["open"]:
                    out.append((file, block, state["place"], "tail" if state["tail"] else "whole", "\n".join(state["held"])))
                    state["place"] += 1
                    state["held"], state["tail"] = [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], columns)
        out = []
        close(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], columns)

    rows = placed.mapInArrow(joined, "file string, block long, place long, kind string, record string")
    stored = f"{checkpoint_dir(spark)}/tessera-csv-records-{uuid.uuid4().hex}"
    rows.write.parquet(stored)
    rows = spark.read.schema(rows.schema).parquet(stored)
    order = Window.partitionBy("file").orderBy("block", "place")
    pieces = rows.where("kind <> 'whole'").withColumn("n", F.count_if(F.col("kind") == "head").over(order))
    whole = pieces.groupBy("file", "n").agg(F.min(F.struct("block", "place")).alias("first"), F.sort_array(F.collect_list(F.struct("block", "place", "record"))).alias("p"))
    whole = whole.select("file", "first.*", F.array_join(F.col("p.record"), "\n").alias("record"))
    return rows.where("kind = 'whole'").drop("kind").unionByName(whole)


def read_judged_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S8 back: quoted CSV with headers and multi-line texts, split among tasks (:func:`csv_records`)."""
    records = csv_records(spark, path).where("(block > 0 or place > 0) and record <> ''")  # each file's first record is its header
    options = {"escape": "\"", "multiLine": "true", "maxCharsPerColumn": "-1", "emptyValue": "", "nullValue": "\u0000"}
    return records.select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_judged_table(judged: DataFrame, path: str) -> None:
    """S9 (re-aimed from a pickle): reloadable Parquet table."""
    judged.write.mode("overwrite").parquet(path)


def write_training_set(df: DataFrame, path: str, text: str = "text") -> None:
    """The trainer's input table (must carry ``text``)."""
    require_columns(df, (text,), "training set").write.mode("overwrite").parquet(path)


def run_stamp(now: _dt.datetime | None = None) -> str:
    """``yyyyMMdd_HHmmss`` stamp for output names."""
    return (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")


def output_name(prefix: str, model_name: str | None = None, ext: str = "json",
                now: _dt.datetime | None = None) -> str:
    """Run-stamped file name; the model name is slugged (``/`` and ``.`` -> ``_``)."""
    stamp = run_stamp(now)
    if model_name:
        return f"{prefix}_{model_name.replace('/', '_').replace('.', '_')}_{stamp}.{ext}"
    return f"{prefix}_{stamp}.{ext}"


model_slug = slug
