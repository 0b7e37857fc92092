"""Evaluation of model outputs against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import py_float
from tessera.functions.tags import DEFAULT_TAGS, Tags
from tessera.functions.text import (between_tags, col, collapse_whitespace, contains, normalize_answer,
                                    normalize_base, numeric_residue)


def check_format(c, tags: Tags = DEFAULT_TAGS) -> Column:
    """All four tags occur anywhere, in any order."""
    return (contains(c, tags.reasoning_start) & contains(c, tags.reasoning_end)
            & contains(c, tags.solution_start) & contains(c, tags.solution_end))


def extract_reasoning(c, tags: Tags = DEFAULT_TAGS) -> Column:
    """Stripped text between the reasoning tags, null if absent."""
    return between_tags(c, tags.reasoning_start, tags.reasoning_end)


def extract_solution(c, tags: Tags = DEFAULT_TAGS) -> Column:
    """Stripped text between the solution tags, null if absent."""
    return between_tags(c, tags.solution_start, tags.solution_end)


def answer_matches(pred, truth) -> Column:
    """Normalized equality, or truth contained in prediction, or numeric
    residues within 0.001 (X12: truth ``5`` matches ``15``; empty truth matches)."""
    p, t = col(pred), col(truth)
    pn, tn = normalize_answer(p), normalize_answer(t)
    pv, tv = py_float(numeric_residue(p)), py_float(numeric_residue(t))
    numeric = F.coalesce(F.abs(pv - tv) < F.lit(0.001), F.lit(False))
    return F.coalesce((pn == tn) | (F.instr(pn, tn) > 0), F.lit(False)) | numeric


def evaluate_rows(df: DataFrame, output: str = "output", truth: str = "ground_truth",
                  tags: Tags = DEFAULT_TAGS, solution: str | None = None) -> DataFrame:
    """Per-row format, answer, reasoning presence and reasoning length.

    Intermediates (reasoning, solution, normalized forms, numeric residues)
    are projected in stages so each is computed once per row. ``solution`` names a column that
    holds the extracted solution already (``rewards.score(..., solution_out=...)``).
    """
    t = F.col(truth)
    s1 = df.withColumns({"__t_r": extract_reasoning(output, tags), "__t_s": F.col(solution) if solution else extract_solution(output, tags)})
    s1b = s1.withColumns({"__t_pb": normalize_base(F.col("__t_s")), "__t_tb": normalize_base(t)})
    s2 = s1b.withColumns({"__t_pn": collapse_whitespace(F.col("__t_pb")),
                          "__t_tn": collapse_whitespace(F.col("__t_tb")),
                          "__t_pr": numeric_residue(F.col("__t_s")), "__t_tr": numeric_residue(t)})
    s3 = s2.withColumns({"__t_pv": py_float(F.col("__t_pr")), "__t_tv": py_float(F.col("__t_tr"))})
    numeric = F.coalesce(F.abs(F.col("__t_pv") - F.col("__t_tv")) < F.lit(0.001), F.lit(False))
    text_match = F.coalesce((F.col("__t_pn") == F.col("__t_tn")) | (F.instr(F.col("__t_pn"), F.col("__t_tn")) > 0),
                            F.lit(False))
    return (s3.withColumns({
        "format_correct": F.coalesce(check_format(output, tags), F.lit(False)),
        "answer_correct": F.coalesce((F.length("__t_s") > 0) & (text_match | numeric), F.lit(False)),
        "has_reasoning": F.coalesce(F.length("__t_r") > 0, F.lit(False)),
        "reasoning_length": F.coalesce(F.length("__t_r"), F.lit(0)),
    }).drop("__t_r", "__t_s", "__t_pb", "__t_tb", "__t_pn", "__t_tn", "__t_pr", "__t_tr", "__t_pv",
            "__t_tv"))


def metrics(rows: DataFrame, reward: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A1/E5: batch metrics (optionally per group); n = 0 -> null metrics.

    The mean reward divides the reward sum by the number of outputs; without
    a reward column it is 0.0, as in the reference.
    """
    n = F.count(F.lit(1))

    def pct(flag: str) -> Column:
        return F.try_divide(F.lit(100.0) * F.count_if(F.col(flag)), n)

    rew = (F.try_divide(F.coalesce(F.sum(reward), F.lit(0.0)), n) if reward
           else F.when(n > 0, F.lit(0.0)))
    aggs = [pct("format_correct").alias("format_accuracy"),
            pct("answer_correct").alias("answer_accuracy"),
            pct("has_reasoning").alias("reasoning_present"),
            F.try_divide(F.sum("reasoning_length").cast("double"), n).alias("avg_reasoning_length"),
            rew.alias("avg_total_reward"),
            n.alias("num_samples")]
    return rows.groupBy(*by).agg(*aggs)


def pair_outputs_truths(outputs: DataFrame, truths: DataFrame, key: str = "id",
                        strict: bool = True) -> DataFrame:
    """Pair outputs with truths on a key.

    Strict mode raises, when the query runs, unless each key is once on both sides. Both sides go through one aggregate on the key,
    so no job runs while the query is built and each side is read once.
    """
    if not strict:
        return outputs.join(truths, on=key, how="full_outer")
    sides = [(outputs, "_o", [c for c in outputs.columns if c != key]), (truths, "_t", [c for c in truths.columns if c != key])]
    rows, aggs, out = [], [], []
    for df, side, names in sides:
        rows.append(df.select(key, F.lit(side).alias("_side"), *[F.col(c).alias(f"{side}{k}") for k, c in enumerate(names)]))
        aggs.append(F.count_if(F.col("_side") == side).alias(f"{side}_n"))
        aggs += [F.first(f"{side}{k}", ignorenulls=True).alias(f"{side}{k}") for k in range(len(names))]
        out += [F.col(f"{side}{k}").alias(c) for k, c in enumerate(names)]
    paired = rows[0].unionByName(rows[1], allowMissingColumns=True).groupBy(key).agg(*aggs)
    odd = F.col(key).isNull() | (F.col("_o_n") != 1) | (F.col("_t_n") != 1)
    raised = F.raise_error(F.lit("Outputs and ground truths must have same length")).cast("boolean")
    return paired.where(F.when(odd, raised).otherwise(True)).select(key, *out)


# --- fixed values: metric log names and summary text ------------------------------
LOG_NAMES = {
    "format_accuracy": "eval/format_accuracy",
    "answer_accuracy": "eval/answer_accuracy",
    "reasoning_present": "eval/reasoning_present",
    "avg_reasoning_length": "eval/avg_reasoning_length",
    "avg_total_reward": "eval/avg_total_reward",
    "num_samples": "eval/num_samples",
}
METRICS_TEXT = ("Evaluation Metrics (n={n}):\n"
                "  Format Accuracy:    {fa}%\n"
                "  Answer Accuracy:    {aa}%\n"
                "  Reasoning Present:  {rp}%\n"
                "  Avg Reasoning Len:  {rl} chars\n"
                "  Avg Total Reward:   {tr}")
# ------------------------------------------------------------------------------------


def metrics_log(m: DataFrame) -> DataFrame:
    """Metrics under their logging names (all values double, as logged)."""
    keep = [c for c in m.columns if c not in LOG_NAMES]
    return m.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in LOG_NAMES.items()])


def metrics_text(m: DataFrame, out: str = "summary") -> DataFrame:
    """Printable summary per metrics row (``.1f`` percentages, ``.0f`` length, ``.2f`` reward)."""
    from tessera.sources.report import fill, fmt
    txt = fill(METRICS_TEXT, n=F.col("num_samples").cast("string"),
               fa=fmt("format_accuracy", "0.0"), aa=fmt("answer_accuracy", "0.0"),
               rp=fmt("reasoning_present", "0.0"), rl=fmt("avg_reasoning_length", "0"),
               tr=fmt("avg_total_reward", "0.00"))
    return m.withColumn(out, txt)
