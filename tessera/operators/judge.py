"""Judge tables: prompts, ground-truth lookup, verdict parsing, flattening,
outcome aggregates and rubric audit (D1-D10, J1, S4, F28, F29).

The judge model itself runs outside; raw verdict text arrives as a column.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.prompts import RUBRIC_WEIGHTS, judge_prompt
from tessera.functions.text import after_last_think, brace_slice, col, fence_body, strip
from tessera.operators.keys import may_hold, membership_map, text_digest
from tessera.operators.messages import message, render
from tessera.functions.tags import DEFAULT_TAGS, Tags

# --- fixed values: defaults --------------------------------------------------
GT_NOT_FOUND = "Ground truth not found"
NA = "N/A"
ERROR_WINNER = "Error"
ERROR_PREFIX = "Error during judgment: "
WINNER_A, WINNER_B, WINNER_TIE = "Model A", "Model B", "Tie"
# -----------------------------------------------------------------------------

CRITERIA = {
    "3": ("correctness", "brevity", "clear_explanation"),
    "4": ("format_adherence", "mathematical_correctness", "clarity_completeness", "conciseness"),
}


def verdict_schema(rubric: str = "3") -> T.StructType:
    scores = T.StructType([T.StructField(c, T.DoubleType()) for c in CRITERIA[rubric]]
                          + [T.StructField("total", T.DoubleType())])
    return T.StructType([
        T.StructField("model_a_scores", scores), T.StructField("model_b_scores", scores),
        T.StructField("model_a_feedback", T.StringType()),
        T.StructField("model_b_feedback", T.StringType()),
        T.StructField("winner", T.StringType()), T.StructField("reason", T.StringType()),
    ])


# ---- ground truth (S4, J1) ------------------------------------------------------

def last_wins_lookup(exercises: DataFrame, key: str = "exercise_text", value: str = "solution_text",
                     order: str = "line_no") -> DataFrame:
    """``key -> value`` where a repeated key keeps its last line (max ``order``).

    ``max_by`` is a partial aggregate, so a hot key is combined map-side.
    """
    return exercises.groupBy(key).agg(F.max_by(value, order).alias(value))


def with_ground_truth(results: DataFrame, lookup: DataFrame, text: str = "problem",
                      key: str = "exercise_text", value: str = "solution_text",
                      out: str = "ground_truth") -> DataFrame:
    """Exact-text lookup with default; joins on ``(xxhash64(text), text)``.

    The 64-bit hash leads the join keys so sort/compare work is done on a
    long, not on long strings; Spark (AQE) picks broadcast or sort-merge from
    runtime sizes, and splits a skewed hot text on the results side.
    """
    lk = lookup.select(F.xxhash64(key).alias("__t_h"), F.col(key).alias("__t_t"), F.col(value).alias("__t_v"))
    r = results.withColumn("__t_h", F.xxhash64(text))
    j = r.join(lk, (r["__t_h"] == lk["__t_h"]) & (r[text] == lk["__t_t"]), "left")
    return (j.withColumn(out, F.coalesce(F.col("__t_v"), F.lit(GT_NOT_FOUND)))
             .drop("__t_h", "__t_t", "__t_v"))


def late_ground_truth(results: DataFrame, exercises: DataFrame, text: str = "problem", key: str = "exercise_text",
                      value: str = "solution_text", order: str = "line_no", out: str = "ground_truth",
                      wanted: DataFrame | None = None, digest=text_digest) -> DataFrame:
    """S4 + J1: last-wins lookup by exact text that groups and joins on a 128-bit digest; texts come late.

    Exercises that no result asks for are left out before any shuffle, by a membership map of fixed size of the results' digests
    (``wanted``, one text column, may name a cheaper superset of the results' texts). The last line of each digest is found from digests and orders
    alone; only these lines' texts and values are fetched. A result's text is compared with the fetched one: two
    texts with one digest raise when the query runs, they are never paired.
    """
    asked = results.select(text) if wanted is None else wanted
    bits = membership_map(asked.select(digest(F.col(asked.columns[0]))[0].alias("h")))
    names = ["__t_h", *[f"__t_h{i}" for i in range(1, len(digest(F.col(text))))]]

    def keyed(df: DataFrame, c: str) -> DataFrame:
        return df.withColumns(dict(zip(names, digest(F.col(c)))))

    lines = keyed(exercises.select(F.col(key).alias("__t_t"), F.col(value).alias("__t_v"), F.col(order).alias("__t_o")), "__t_t").where(may_hold(bits, F.col(names[0])))
    last = lines.groupBy(*names).agg(F.max("__t_o").alias("__t_o"))
    late = lines.join(last, [*names, "__t_o"]).withColumn("__t_is", F.lit(True))
    joined = keyed(results, text).join(late, names, "left")
    differ = F.col("__t_is") & (F.col(text) != F.col("__t_t"))
    checked = F.when(differ, F.raise_error(F.lit("two texts share a digest; pass a longer digest")).cast("string")).otherwise(F.col("__t_v"))
    return joined.withColumn(out, F.coalesce(checked, F.lit(GT_NOT_FOUND))).drop(*names, "__t_t", "__t_v", "__t_o", "__t_is")


# ---- prompts (D1, D2) -----------------------------------------------------------

def judge_prompts(pairs: DataFrame, problem: str = "problem", ground_truth: str = "ground_truth",
                  base: str = "base_response", tuned: str = "sft_response", rubric: str = "3",
                  as_chat: bool = False, tags: Tags = DEFAULT_TAGS, out: str = "judge_prompt") -> DataFrame:
    """D1/D2; ``as_chat`` wraps it as one user turn rendered with the chat template."""
    p = judge_prompt(problem, ground_truth, base, tuned, rubric)
    if as_chat:
        p = render(F.array(message("user", p)), tags, add_generation_prompt=True)
    return pairs.withColumn(out, p)


# ---- verdict parsing (D3-D6) ----------------------------------------------------

def with_verdict_json_text(df: DataFrame, raw: str = "raw", dialect: str = "full",
                           out: str = "json_text") -> DataFrame:
    """The JSON text of a reply, as staged projections (each step computed once per row).

    D4 (``full``): strip -> fence body -> after last think -> brace slice.
    D3 (``fence``): strip -> fence body -> strip.
    """
    staged = df.withColumn("__t_t1", fence_body(strip(raw)))
    if dialect == "fence":
        return staged.withColumn(out, strip(F.col("__t_t1"))).drop("__t_t1")
    if dialect != "full":
        raise ValueError(f"unknown verdict dialect {dialect!r}")
    staged = staged.withColumn("__t_t2", after_last_think(F.col("__t_t1")))
    return staged.withColumn(out, brace_slice(F.col("__t_t2"))).drop("__t_t1", "__t_t2")


#: Second element of the array that the JSON check builds around a text.
_MARK = "end of the verdict"


def is_json_object(text: Column) -> Column:
    """Whether ``text`` is one strict JSON object, checked by Spark's variant parser.

    Spark's JSON reader accepts trailing text, so the text is made the first element of an array: the
    mark is the second one only if the text is one whole value. The variant parser refuses ``NaN`` and
    repeated keys, which Python accepts; :func:`json_error` decides on refused texts.
    """
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))
    whole = (F.instr(text, _MARK) == 0) & (F.try_variant_get(array, "$[1]", "string") == _MARK)
    return F.coalesce(F.btrim(text, F.lit(" \t\r\n")).startswith("{") & whole, F.lit(False))


def json_error(text: Column) -> Column:
    """Strict JSON check with Python ``json.loads`` rules (Arrow-batched).

    Returns null for a JSON object, else the parser's message. Only texts that
    :func:`is_json_object` refuses are worth sending here; parsing itself stays in ``from_json``.
    """
    @F.pandas_udf("string")
    def _err(s: pd.Series) -> pd.Series:
        import json

        def one(x):
            if x is None:
                return "the JSON object must be str, bytes or bytearray, not NoneType"
            try:
                v = json.loads(x)
            except Exception as e:  # noqa: BLE001 - message is the output
                return str(e)
            return None if isinstance(v, dict) else "verdict is not a JSON object"
        return s.map(one)

    return _err(text)


def default_verdict(reason: Column, rubric: str = "3") -> Column:
    """Totals 0, winner ``Error``, reason text; other fields null."""
    sch = verdict_schema(rubric)
    scores_t = sch["model_a_scores"].dataType
    zero = F.struct(*[(F.lit(0.0) if f.name == "total" else F.lit(None).cast(f.dataType)).alias(f.name)
                      for f in scores_t.fields])
    return F.struct(zero.alias("model_a_scores"), zero.alias("model_b_scores"),
                    F.lit(None).cast("string").alias("model_a_feedback"),
                    F.lit(None).cast("string").alias("model_b_feedback"),
                    F.lit(ERROR_WINNER).alias("winner"),
                    F.concat(F.lit(ERROR_PREFIX), reason).alias("reason"))


def parse_verdicts(df: DataFrame, raw: str = "raw", rubric: str = "3", dialect: str = "full",
                   out: str = "verdict") -> DataFrame:
    """D3/D4 + D5: parse raw judge replies into a verdict struct.

    A reply is valid when the extracted text is a JSON object (Python rules)
    holding ``winner`` and both ``total`` scores (X8). Without these keys the winner
    is ``Error`` and a missing total 0; criteria, feedback and reason stay as given. A text
    that is no JSON object gets the default error verdict. An absent reason names the
    failure class ("invalid JSON" / "missing 'winner' or 'total'"); ``parse_error`` keeps
    the class or the parser's own message.
    """
    sch = verdict_schema(rubric)
    staged = with_verdict_json_text(df, raw, dialect, "__t_jt")
    staged = staged.withColumn("__t_ok", is_json_object(F.col("__t_jt")))
    # the UDF gets refused texts only; the others reach it as null
    staged = staged.withColumn("__t_je", json_error(F.when(~F.col("__t_ok"), F.col("__t_jt"))))
    staged = staged.withColumn("__t_je", F.when(~F.col("__t_ok"), F.col("__t_je")))
    parsed = F.from_json(F.col("__t_jt"), sch)
    staged = staged.withColumn("__t_pv", F.when(F.col("__t_je").isNull(), parsed))
    missing = (F.col("__t_pv.winner").isNull() | F.col("__t_pv.model_a_scores.total").isNull()
               | F.col("__t_pv.model_b_scores.total").isNull())
    kind = (F.when(F.col("__t_je").isNotNull(), F.lit("invalid JSON"))
             .when(missing, F.lit("missing 'winner' or 'total'")))
    detail = F.when(F.col("__t_je").isNotNull(), F.col("__t_je")).when(missing, kind)
    p = F.col("__t_pv")

    def scores(side: str) -> Column:
        return F.struct(*[p[side][c].alias(c) for c in CRITERIA[rubric]],
                        F.coalesce(p[side]["total"], F.lit(0.0)).alias("total")).alias(side)

    partial = F.struct(scores("model_a_scores"), scores("model_b_scores"),
                       p["model_a_feedback"].alias("model_a_feedback"), p["model_b_feedback"].alias("model_b_feedback"),
                       F.lit(ERROR_WINNER).alias("winner"),
                       F.coalesce(p["reason"], F.concat(F.lit(ERROR_PREFIX), kind)).alias("reason"))
    return (staged.withColumn("parse_error", detail)
                  .withColumn(out, F.when(kind.isNull(), p).when(F.col("__t_je").isNull(), partial)
                              .otherwise(default_verdict(kind, rubric)))
                  .drop("__t_jt", "__t_ok", "__t_je", "__t_pv"))


def flatten_verdicts(df: DataFrame, verdict: str = "verdict", problem_id: str = "problem_id",
                     question: str = "problem", ground_truth: str = "ground_truth",
                     base: str = "base_response", tuned: str = "sft_response",
                     rubric: str = "3", fill: bool = True) -> DataFrame:
    """The judged table; missing scores 0, missing texts ``N/A``.

    ``fill=False`` leaves the missing ones null, as the report needs them (:func:`fill_missing` later).
    """
    v = F.col(verdict)
    sc = []
    for prefix, side in (("base", "model_a_scores"), ("sft", "model_b_scores")):
        sc += [v[side][c].alias(f"{prefix}_{c}") for c in CRITERIA[rubric]]
        sc.append(v[side]["total"].alias(f"{prefix}_total_score"))
    gt = F.col(ground_truth) if ground_truth in df.columns else F.lit(None).cast("string")
    flat = df.select(
        F.col(problem_id).alias("problem_id"), F.col(question).alias("question"),
        gt.alias("ground_truth_answer"), F.col(base).alias("base_model_answer"),
        F.col(tuned).alias("sft_model_answer"), v["model_a_feedback"].alias("judge_response_base"),
        v["model_b_feedback"].alias("judge_response_sft"), *sc,
        v["winner"].alias("winner"), v["reason"].alias("reason"))
    return fill_missing(flat) if fill else flat


def fill_missing(flat: DataFrame) -> DataFrame:
    """The judged table of an unfilled one: missing scores 0, missing texts ``N/A``."""
    kept = ("problem_id", "question", "base_model_answer", "sft_model_answer")
    return flat.select(*[c if c in kept else F.coalesce(F.col(c), F.lit(0.0) if t == "double" else F.lit(NA)).alias(c)
                         for c, t in flat.dtypes])


# ---- aggregates (D7-D9) and audit (D10) -----------------------------------------

def judge_outcomes(judged: DataFrame, winner: str = "winner", by: Sequence[str] = ()) -> DataFrame:
    """Wins per side, ties, errors and percentages (one partial aggregate)."""
    n = F.count(F.lit(1))
    agg = judged.groupBy(*by).agg(
        F.count_if(F.col(winner) == WINNER_B).alias("sft_wins"),
        F.count_if(F.col(winner) == WINNER_A).alias("base_wins"),
        F.count_if(F.col(winner) == WINNER_TIE).alias("ties"),
        F.count_if(F.col(winner) == ERROR_WINNER).alias("errors"),
        n.alias("total_problems"))
    # reference order: count / total * 100
    pct = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total_problems")) * F.lit(100.0)
    return agg.select("*", *[pct(c).alias(f"{c}_pct") for c in ("sft_wins", "base_wins", "ties", "errors")])


def judge_averages(judged: DataFrame, base_total: str = "base_total_score",
                   sft_total: str = "sft_total_score", by: Sequence[str] = ()) -> DataFrame:
    """Average total per model and the signed difference (errors count as 0)."""
    agg = judged.groupBy(*by).agg(F.avg(base_total).alias("avg_base_score"),
                                  F.avg(sft_total).alias("avg_sft_score"))
    return agg.withColumn("score_difference", F.col("avg_sft_score") - F.col("avg_base_score"))


def judge_margin(outcomes: DataFrame) -> DataFrame:
    """Win margin and the three-way finding."""
    s, b, n = F.col("sft_wins"), F.col("base_wins"), F.col("total_problems")
    margin = F.when(s > b, s - b).when(b > s, b - s).otherwise(F.lit(0)).cast("bigint")
    finding = F.when(s > b, F.lit("tuned")).when(b > s, F.lit("base")).otherwise(F.lit("equal"))
    return outcomes.select("*", margin.alias("margin"), finding.alias("finding"),
                           (F.try_divide(margin.cast("double"), n) * F.lit(100.0)).alias("margin_pct"))


def rubric_audit(judged: DataFrame, rubric: str = "3") -> DataFrame:
    """Recompute each total from the criteria with the prompt's weights."""
    w = RUBRIC_WEIGHTS[rubric]
    cols = {}
    for side in ("base", "sft"):
        weighted = None
        for crit, wt in w.items():
            term = F.col(f"{side}_{crit}") * F.lit(wt)
            weighted = term if weighted is None else weighted + term
        cols[f"{side}_weighted_total"] = weighted
        cols[f"{side}_total_gap"] = F.col(f"{side}_total_score") - weighted
    return judged.withColumns(cols)


def judge_summary(judged: DataFrame, winner: str = "winner", base_total: str = "base_total_score",
                  sft_total: str = "sft_total_score", by: Sequence[str] = ()) -> DataFrame:
    """D7 + D8 + D9 in one partial aggregate (one pass over the judged table)."""
    n = F.count(F.lit(1))
    agg = judged.groupBy(*by).agg(
        F.count_if(F.col(winner) == WINNER_B).alias("sft_wins"),
        F.count_if(F.col(winner) == WINNER_A).alias("base_wins"),
        F.count_if(F.col(winner) == WINNER_TIE).alias("ties"),
        F.count_if(F.col(winner) == ERROR_WINNER).alias("errors"),
        n.alias("total_problems"),
        F.avg(base_total).alias("avg_base_score"), F.avg(sft_total).alias("avg_sft_score"))
    # reference order: count / total * 100
    pct = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total_problems")) * F.lit(100.0)
    out = agg.select("*", *[pct(c).alias(f"{c}_pct") for c in ("sft_wins", "base_wins", "ties", "errors")],
                     (F.col("avg_sft_score") - F.col("avg_base_score")).alias("score_difference"))
    return judge_margin(out)
