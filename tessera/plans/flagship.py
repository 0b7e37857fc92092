"""Flagship: score every completion with the four package rewards, sum them,
and add the group-relative advantage over each prompt's generations.

Scoring runs once; statistics and rows share one exchange of the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import rewards as R
from tessera.plans.fixtures import fixture


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.score(fixture(spark, sf_dir, "completions"), rewards=R.enabled_rewards())
    # the scores move once, without the texts
    narrow = scored.select("prompt_id", "gen_id", "answer", "reward_format_exact", "reward_format_approx",
                           "reward_answer", "reward_numbers", "total")
    return R.group_advantage(narrow, "prompt_id", "total")
