"""End-to-end jobs for the reference's three flows, built only from
the operators in this package. Each reads its inputs, writes its outputs
with many tasks, and returns small driver-side values (counts, budgets).

* :func:`sft_set_job` — §3.1: scan → numeric filter → messages → rendered
  text + length → length filter → training table.
* :func:`rl_set_job` — §3.2: scan → prompt lengths → percentile filter →
  budget → prompt messages → optional exact split → tables.
* :func:`judge_prompts_job` / :func:`judge_results_job` — §3.3: comparison
  results + exercises → judge prompts; raw verdicts → judged table (CSV +
  Parquet) and markdown report. The judge model runs in between, outside.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tags import DEFAULT_TAGS, Tags
from tessera.operators import compare as C
from tessera.operators import judge as J
from tessera.operators import lengths as L
from tessera.operators import messages as M
from tessera.operators import split as S
from tessera.session import checkpoint_dir
from tessera.sources import io as IO
from tessera.sources.report import judge_report_lines, write_report


def sft_set_job(spark: SparkSession, source: str, out: str, fmt: str = "parquet",
                tags: Tags = DEFAULT_TAGS, max_seq_length: int = 2048, truncate_ratio: float = 0.5,
                filter_numeric_only: bool = True, length_fn="regex_tokens") -> DataFrame:
    """Write the SFT training table (``text``, ``N`` and the source columns); returns it (lazy read)."""
    df = IO.load_sft(spark, source, fmt)
    if filter_numeric_only:
        df = L.numeric_answer_filter(df)
    m = M.sft_messages(df, tags)
    r = L.with_length(m.withColumn("text", M.render("Messages", tags)), "text", "N", length_fn)
    IO.write_training_set(L.length_filter(r, "N", max_seq_length, truncate_ratio), out)
    return spark.read.parquet(out)


def rl_set_job(spark: SparkSession, source: str, out: str, fmt: str = "parquet",
               tags: Tags = DEFAULT_TAGS, system_prompt: str | None = None, percentile: float = 90,
               max_seq_length: int = 2048, train_ratio: float | None = None, key: str | None = None,
               seed: int = 42, length_fn="regex_tokens") -> dict:
    """Write the RL prompt table(s); returns the sequence budget.

    With ``train_ratio`` and a unique ``key`` the table is split exactly
    (``train/`` and ``eval/``); otherwise one table is written.
    """
    sp = tags.system_prompt if system_prompt is None else system_prompt
    df = M.rename_solution_to_answer(IO.load_rl(spark, source, fmt=fmt))
    msgs = F.array(M.message("system", F.lit(sp)), M.message("user", F.col("prompt")))
    lengths = L.with_length(df.withColumn("_pt", M.render(msgs, tags, add_generation_prompt=True)),
                            "_pt", "prompt_length", length_fn).drop("_pt")
    # written once (tokenizing pass); the threshold, the split and the outputs read the stored lengths
    stored = f"{checkpoint_dir(spark)}/rl-set-{uuid.uuid4().hex}"
    lengths.write.parquet(stored)
    lengths = spark.read.schema(lengths.schema).parquet(stored)
    budget = L.sequence_budget(L.percentile_threshold(lengths, "prompt_length", percentile), max_seq_length).first().asDict()
    kept = lengths.where(F.col("prompt_length") <= F.lit(budget["max_prompt_length"]))
    prompts = M.rl_messages(kept, sp, prompt="prompt")
    if train_ratio is not None:
        if key is None:
            raise ValueError("an exact split needs a unique key column")
        in_train = S.membership(kept, key, train_ratio, seed)
        prompts.where(in_train).write.mode("overwrite").parquet(f"{out}/train")
        prompts.where(~in_train).write.mode("overwrite").parquet(f"{out}/eval")
    else:
        prompts.write.mode("overwrite").parquet(out)
    return budget


def judge_prompts_job(spark: SparkSession, comparison: str, exercises: str, out: str,
                      rubric: str = "3", as_chat: bool = False, tags: Tags = DEFAULT_TAGS) -> DataFrame:
    """Comparison JSON + exercises JSONL -> judge prompts (one row per problem)."""
    pairs = C.pair_models(IO.read_comparison(spark, comparison), value_cols=("response",))
    with_gt = J.late_ground_truth(pairs, IO.read_exercises(spark, exercises), "problem", wanted=IO.read_comparison(spark, comparison).select("problem"))
    prompts = J.judge_prompts(with_gt, rubric=rubric, as_chat=as_chat, tags=tags)
    prompts.select("problem_id", "problem", "ground_truth", "base_response", "sft_response",
                   "judge_prompt").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def judge_results_job(spark: SparkSession, prompts: str, raw_verdicts: DataFrame, out: str,
                      base_name: str, sft_name: str, judge_name: str, rubric: str = "3",
                      dialect: str = "full") -> dict:
    """Raw judge replies ``(problem_id, raw)`` -> judged table (CSV + Parquet) + report.

    A problem without a reply counts as an error. Returns the outcome summary row (counts, averages, margin).
    """
    replies = spark.read.parquet(prompts).join(raw_verdicts, "problem_id", "left")
    flat = J.flatten_verdicts(J.parse_verdicts(replies, "raw", rubric, dialect), rubric=rubric, fill=False)
    IO.write_judged_table(flat, f"{out}/verdicts")
    flat = spark.read.parquet(f"{out}/verdicts")  # written once, read below
    IO.write_judged_table(J.fill_missing(flat), f"{out}/judged")
    judged = spark.read.parquet(f"{out}/judged")
    IO.write_judged_csv(judged, f"{out}/judged_csv")
    generated = dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    write_report(judge_report_lines(flat, base_name, sft_name, judge_name, generated, rubric), f"{out}/report")
    return J.judge_summary(judged).first().asDict()
