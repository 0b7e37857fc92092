"""End-to-end jobs over data derived from the driver tables."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.plans import jobs
from tessera.plans.fixtures import fixture
from tessera.operators import compare as C
from tessera.sources import io as IO


def test_sft_set_job(spark, sf):
    d = tempfile.mkdtemp(prefix="tessera-job-")
    fixture(spark, sf, "sft_raw").select("expected_answer", "problem", "generated_solution") \
        .write.parquet(f"{d}/src")
    out = jobs.sft_set_job(spark, f"{d}/src", f"{d}/out")
    rows = out.collect()
    assert rows and all(r.N <= 1024 for r in rows) and all(r.text.endswith("<|endoftext|>") for r in rows)
    import pandas as pd
    answers = pd.Series([r.expected_answer for r in rows], dtype=object)
    assert pd.to_numeric(answers, errors="coerce").notnull().all()


def test_rl_set_job_with_split(spark, sf):
    d = tempfile.mkdtemp(prefix="tessera-job-")
    spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("id"), F.col("text").alias("prompt"),
        F.col("item_id").cast("string").alias("solution")).write.parquet(f"{d}/src")
    budget = jobs.rl_set_job(spark, f"{d}/src", f"{d}/out", train_ratio=0.75, key="id")
    assert budget["max_prompt_length"] + budget["max_completion_length"] == 2048
    tr, ev = spark.read.parquet(f"{d}/out/train"), spark.read.parquet(f"{d}/out/eval")
    n = tr.count() + ev.count()
    assert tr.count() == int(n * 0.75) and "answer" in tr.columns
    assert tr.first().prompt[0].role == "system"


def test_judge_jobs(spark, sf):
    d = tempfile.mkdtemp(prefix="tessera-job-")
    res = C.with_format_check(fixture(spark, sf, "responses"))
    pairs = C.pair_models(res)
    IO.write_comparison(pairs, C.pair_summary(pairs), f"{d}/cmp", "base-m", "tuned-m")
    with open(f"{d}/ex.jsonl", "w") as f:
        for r in fixture(spark, sf, "exercises").orderBy("doc_id").collect():
            f.write(json.dumps({"exercise_number": r.exercise_number, "exercise_text": r.exercise_text,
                                "solution_text": r.solution_text}) + "\n")
    prompts = jobs.judge_prompts_job(spark, f"{d}/cmp", f"{d}/ex.jsonl", f"{d}/prompts")
    assert prompts.count() == pairs.count()
    raw = fixture(spark, sf, "verdicts")
    summary = jobs.judge_results_job(spark, f"{d}/prompts", raw, f"{d}/out", "base-m", "tuned-m", "judge")
    assert summary["total_problems"] == prompts.count() > raw.count()  # a problem without a reply is an error
    assert summary["errors"] > 0 and summary["sft_wins"] + summary["base_wins"] + summary["ties"] + summary["errors"] \
        == summary["total_problems"]
    report = "".join(open(os.path.join(f"{d}/out/report", p)).read()
                     for p in sorted(os.listdir(f"{d}/out/report")) if p.startswith("part-"))
    assert report.startswith("# LLM Judge Evaluation Report") and "## Conclusion" in report and "| N/A |" in report
    four = jobs.judge_results_job(spark, f"{d}/prompts", fixture(spark, sf, "verdicts_4"), f"{d}/four", "base-m", "tuned-m", "judge", rubric="4")
    text = "".join(r.value for r in spark.read.text(f"{d}/four/report").collect())
    assert four["errors"] > 0 and "# AI Judge Evaluation Report" in text and "| Model | Format | Math | Clarity | Concise |" in text


def test_cli_score(spark, sf, capsys):
    from tessera.__main__ import main
    d = tempfile.mkdtemp(prefix="tessera-cli-")
    fixture(spark, sf, "completions").write.parquet(f"{d}/in")
    assert main(["score", "--source", f"{d}/in", "--out", f"{d}/out", "--advantage-key", "prompt_id"]) == 0
    out = spark.read.parquet(f"{d}/out")
    assert {"total", "advantage", "reward_answer"} <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{d}/in").count()


def test_tokenizer_length(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers
    from tessera.operators import lengths as L
    d = tempfile.mkdtemp(prefix="tessera-tok-")
    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "hello": 1, "world": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(f"{d}/tokenizer.json")
    df = spark.createDataFrame([("hello world",), ("hello, big world!",), (None,)], "text string")
    got = [r.N for r in L.with_length(df, "text", "N", L.tokenizer_length(f"{d}/tokenizer.json")).collect()]
    assert got == [2, 5, None]


def test_rl_set_job_without_split(spark, sf):
    d = tempfile.mkdtemp(prefix="tessera-job-")
    spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text").alias("prompt"),
                                                         F.lit("1").alias("answer")).write.parquet(f"{d}/src")
    budget = jobs.rl_set_job(spark, f"{d}/src", f"{d}/out", percentile=50)
    out = spark.read.parquet(f"{d}/out")
    assert out.count() >= 1 and all(r.prompt_length <= budget["max_prompt_length"] for r in out.collect())
