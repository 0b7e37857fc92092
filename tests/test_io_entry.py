"""S1-S13 round trips, reports, streaming, and the driver contract."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import compare as C
from tessera.sources import io as IO
from tessera.sources.report import comparison_report_lines, write_report


def _pairs(spark):
    rows = [(1, "base", "p1", "<end_working_out><SOLUTION>1</SOLUTION>"), (1, "tuned", "p1", "x\ny"),
            (2, "base", "p2", "b"), (2, "tuned", "p2", "<end_working_out><SOLUTION>2</SOLUTION>")]
    res = C.with_format_check(spark.createDataFrame(rows, "problem_id long, model string, problem string, response string"))
    return C.pair_models(res)


def test_comparison_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    pairs = _pairs(spark)
    side = lambda r, p: {"response": r[f"{p}_response"], "format_check": r[f"{p}_format_check"].asDict()}
    with open(f"{d}/doc.json", "w") as f:
        json.dump({"metadata": {"base_model": "base/m-1.5", "sft_model": "tuned"},
                   "results": [{"problem_id": r.problem_id, "problem": r.problem, "base_model": side(r, "base"), "sft_model": side(r, "sft")}
                               for r in pairs.collect()]}, f, indent=2)
    back = IO.read_comparison(spark, f"{d}/doc.json")
    got = sorted((r.problem_id, r.model, r.response, r.format_check.format_ok) for r in back.collect())
    assert got == [(1, "base", "<end_working_out><SOLUTION>1</SOLUTION>", True), (1, "tuned", "x\ny", False),
                   (2, "base", "b", False), (2, "tuned", "<end_working_out><SOLUTION>2</SOLUTION>", True)]
    IO.write_comparison(pairs, C.pair_summary(pairs), f"{d}/dist", "b", "t")
    assert spark.read.json(f"{d}/dist/results").count() == 2
    assert spark.read.json(f"{d}/dist/metadata").first().num_problems == 2
    assert spark.read.json(f"{d}/dist/summary").first().improvement == 0
    dist = sorted((r.problem_id, r.model, r.response, r.format_check.format_ok) for r in IO.read_comparison(spark, f"{d}/dist").collect())
    assert dist == got


def test_readers_raise_instead_of_losing_rows(spark):
    import pytest
    from tessera.operators import evaluate as EV
    d = tempfile.mkdtemp(prefix="tessera-io-")
    spark.createDataFrame([("p",)], "prompt string").write.parquet(f"{d}/rl")
    with pytest.raises(ValueError):
        IO.load_rl(spark, f"{d}/rl", split="test")
    spark.createDataFrame([(1,)], "other long").write.json(f"{d}/none")
    with pytest.raises(Exception, match="no results"):
        IO.read_comparison(spark, f"{d}/none").collect()
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
    with pytest.raises(Exception, match="must have same length"):
        EV.pair_outputs_truths(twice, twice.withColumnRenamed("x", "y")).collect()


def test_csv_and_table_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    df = spark.createDataFrame([(1, 'multi\nline "quoted", text', 2.5)], "problem_id long, question string, s double")
    IO.write_judged_csv(df, f"{d}/csv")
    back = IO.read_judged_csv(spark, f"{d}/csv", df.schema).collect()
    assert back == df.collect()
    IO.write_judged_table(df, f"{d}/pq")
    assert spark.read.parquet(f"{d}/pq").collect() == df.collect()


def test_exercises_and_loaders(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    with open(f"{d}/ex.jsonl", "w") as f:
        for n, t, s in [(1, "a", "s1"), (2, "b", "t"), (3, "a", "s2")]:
            f.write(json.dumps({"exercise_number": n, "exercise_text": t, "solution_text": s}) + "\n")
    ex = IO.read_exercises(spark, f"{d}/ex.jsonl")
    from tessera.operators.judge import last_wins_lookup
    got = {r.exercise_text: r.solution_text for r in last_wins_lookup(ex).collect()}
    assert got == {"a": "s2", "b": "t"}
    # a later, larger file wins: Spark would number its rows first
    os.mkdir(f"{d}/two")
    for name, value, n in (("a.jsonl", "first", 1), ("b.jsonl", "last", 500)):
        with open(f"{d}/two/{name}", "w") as f:
            for k in range(n):
                f.write(json.dumps({"exercise_number": k, "exercise_text": f"q{k}", "solution_text": value}) + "\n")
    both = {r.exercise_text: r.solution_text for r in last_wins_lookup(IO.read_exercises(spark, f"{d}/two")).collect()}
    assert set(both.values()) == {"last"} and len(both) == 500
    sft = spark.createDataFrame([("1", "p", "g", "extra")], "expected_answer string, problem string, "
                                                              "generated_solution string, other string")
    sft.write.parquet(f"{d}/sft")
    assert IO.load_sft(spark, f"{d}/sft").columns == list(IO.SFT_COLUMNS)
    with pytest.raises(ValueError):
        IO.load_rl(spark, f"{d}/sft")


def test_names():
    import datetime as dt
    now = dt.datetime(2025, 1, 2, 3, 4, 5)
    assert IO.run_stamp(now) == "20250102_030405"
    assert IO.output_name("third_party_results", "org/model-1.5", now=now) == \
        "third_party_results_org_model-1_5_20250102_030405.json"


def test_report_written_in_order(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    lines = comparison_report_lines(_pairs(spark), "b", "t")
    write_report(lines, f"{d}/rep")
    text = "".join(open(os.path.join(f"{d}/rep", f)).read() for f in sorted(os.listdir(f"{d}/rep"))
                   if f.startswith("part-"))
    assert text.index("# Base vs SFT") < text.index("## Problem 1") < text.index("## Problem 2") < text.index("## Summary")


def test_streaming_scoring(spark):
    from tessera.streaming.scoring import score_stream
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    spark.createDataFrame([(1, 1, "42", "<start_working_out>w<end_working_out><SOLUTION>42</SOLUTION>")],
                          "prompt_id long, gen_id int, answer string, completion string").write.parquet(f"{d}/in")
    q = score_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{d}/out").first().total == 13.5


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 45
    for name, fn in qs.items():
        if name in ("exact_split_members", "exact_split_sizes"):
            continue  # run jobs while planning; covered in test_split
        assert fn(spark, "/root/testdata/sf0.001").columns, name


def test_single_model_and_training_set_writers(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    res = C.with_format_check(spark.createDataFrame(
        [(1, "p", "<end_working_out><SOLUTION>1</SOLUTION>"), (2, "q", "none")],
        "problem_id long, problem string, response string"))
    IO.write_single_model(res, C.single_summary(res), f"{d}/single", "org/m", "third_party")
    back = spark.read.json(f"{d}/single/results")
    read = IO.read_single_model(spark, f"{d}/single")
    assert {(r.problem_id, r.format_check.format_ok, r.model_name, r.model_type) for r in read.collect()} == \
        {(1, True, "org/m", "third_party"), (2, False, "org/m", "third_party")}
    assert back.count() == 2 and spark.read.json(f"{d}/single/summary").first().correct_format == 1
    IO.write_training_set(spark.createDataFrame([("t",)], "text string"), f"{d}/train")
    with pytest.raises(ValueError):
        IO.write_training_set(spark.createDataFrame([("t",)], "other string"), f"{d}/bad")


def test_guards_head_and_first_content(spark):
    from tessera.operators.lengths import require_non_empty
    from tessera.operators.messages import MSG_TYPE, first_content
    from tessera.operators.split import head
    with pytest.raises(ValueError):
        require_non_empty(spark.createDataFrame([], "a int"))
    df = spark.createDataFrame([(2,), (1,), (3,)], "a int")
    assert [r.a for r in head(df, ["a"], 2).collect()] == [1, 2]
    m = spark.createDataFrame([([{"role": "assistant", "content": "hi"}],), ([],)], f"c {MSG_TYPE}")
    assert [r.x for r in m.select(first_content("c").alias("x")).collect()] == ["hi", None]


def test_streaming_available_now(spark):
    from tessera.streaming.scoring import score_stream
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    spark.createDataFrame([(1, 1, "0", "no formatting here")],
                          "prompt_id long, gen_id int, answer string, completion string").write.parquet(f"{d}/in")
    q = score_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", dialect="notebook", available_now=True)
    q.awaitTermination(120)
    r = spark.read.parquet(f"{d}/out").first()
    assert r.reward_format_exact == 0.0 and r.reward_answer == -2.0
