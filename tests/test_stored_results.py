"""Results written together, quoted CSV read by many tasks, reports in order without a sort's sampling pass."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import compare as C
from tessera.operators.ranges import in_order
from tessera.sources import io as IO
from tessera.sources.report import write_report


def results(spark, n):
    rows = [(k, m, f"p{k}", f"<end_working_out><SOLUTION>{k}</SOLUTION>" if (k + len(m)) % 2 else "plain") for k in range(n) for m in ("base", "tuned")]
    return C.with_format_check(spark.createDataFrame(rows, "problem_id long, model string, problem string, response string"))


def test_failed_write_leaves_the_old_results(spark, tmp_path):
    path = str(tmp_path / "cmp")
    pairs = C.pair_models(results(spark, 4))
    IO.write_comparison(pairs, C.pair_summary(pairs), path, "b", "t")
    old = sorted(map(str, IO.read_comparison(spark, path).collect()))
    bad = C.pair_models(results(spark, 9))
    failing = C.pair_summary(bad).withColumn("improvement", F.raise_error(F.lit("no summary")).cast("long"))
    with pytest.raises(Exception, match="no summary"):
        IO.write_comparison(bad, failing, path, "b2", "t2")
    assert sorted(map(str, IO.read_comparison(spark, path).collect())) == old
    assert sorted(os.listdir(path)) == ["metadata", "results", "summary"] and spark.read.json(f"{path}/summary").count() == 1
    IO.write_comparison(bad, C.pair_summary(bad), path, "b2", "t2")
    new = IO.read_comparison(spark, path)
    assert new.count() == 18 and {r.model_name for r in new.collect()} == {"b2", "t2"} and sorted(os.listdir(path)) == ["metadata", "results", "summary"]


def test_tables_are_replaced_together(spark, tmp_path):
    path = str(tmp_path / "out")
    one, two = spark.range(3), spark.range(5)
    IO.write_together(path, {"a": one, "b": one})
    IO.write_together(path, {"a": two, "b": two, "c": two})
    assert [spark.read.json(f"{path}/{n}").count() for n in "abc"] == [5, 5, 5]
    with pytest.raises(Exception):
        IO.write_together(path, {"a": one, "missing/parent/name": one.select(F.raise_error(F.lit("x")))})
    assert spark.read.json(f"{path}/a").count() == 5


@pytest.mark.parametrize("split", ["1500", "20000", "128m"])
def test_quoted_csv_is_read_by_splits(spark, tmp_path, split):
    r = random.Random(3)

    def text():
        return "".join(r.choice(["a", '"', "\n", ",", " ", "é", '""', "\r", "x" * 30]) for _ in range(r.randint(0, 40)))

    rows = [(i, text(), text() + "z" * r.choice([0, 0, 1000]), r.random()) for i in range(100)] + [(1000, "\n" * 2000, '"' * 2001, 0.0)]
    df = spark.createDataFrame(rows, "id long, a string, b string, d double").repartition(3)
    path = str(tmp_path / "csv")
    IO.write_judged_csv(df, path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        back = IO.read_judged_csv(spark, path, df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(rows) and back.schema.names == df.schema.names
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    IO.write_judged_csv(df.limit(0), path + "0")
    assert IO.read_judged_csv(spark, path + "0", df.schema).collect() == []


def test_in_order_as_order_by(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice([0, 1, 2, 2, 2, 2]), r.randrange(1000), f"t{k}") for k in range(3000)] + [(2, None, "none")]
    df = spark.createDataFrame(rows, "block int, problem_id long, text string").repartition(7)
    for p in (1, 2, 8, 33):
        got = [(x.block, x.problem_id) for x in in_order(df, ["block", "problem_id"], p).collect()]
        assert got == [(x.block, x.problem_id) for x in df.orderBy("block", "problem_id").collect()]
    sizes = in_order(df.where("problem_id is not null"), ["problem_id", "text"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert 6 <= len(sizes) <= 8 and max(x["count"] for x in sizes) < 3 * 3000 / 8
    write_report(df.where("text like 't1%'"), str(tmp_path / "r"), 4)
    parts = [p for p in sorted(os.listdir(tmp_path / "r")) if p.startswith("part")]
    lines = "".join((tmp_path / "r" / p).read_text() for p in parts).split()
    order = {x.text: (x.block, x.problem_id) for x in df.collect()}
    assert [order[x] for x in lines] == sorted(order[x] for x in lines) and len(lines) == len([x for x in order if x.startswith("t1")])
    assert in_order(df.limit(0), ["block"], 4).collect() == []


def test_report_texts_are_made_once(spark, tmp_path):
    """Only the order columns are read for the ranges: the texts' plan runs once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return f"t{x}"

    df = spark.range(500).select(F.lit(1).alias("block"), F.col("id").alias("problem_id"), counted("id").alias("text"))
    write_report(df, str(tmp_path / "r"), 4)
    assert seen.value == 500
