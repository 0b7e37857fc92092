"""Markdown reports as ordered text tables.

A report is a DataFrame ``(block, problem_id, text)``: header and summary
blocks are one row each, problem sections one row per problem. Writing it
with :func:`write_report` sorts by ``(block, problem_id)`` and emits text
parts in that order, so no step gathers the report into one task.

Report texts are templates with ``{name}`` placeholders; :func:`fill`
turns a template into one ``concat`` of literals and columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import in_order
from tessera.functions.tags import DEFAULT_TAGS, Tags
from tessera.operators import compare as C
from tessera.operators import judge as J

# --- fixed values: report texts -------------------------------------------------
CMP_HEADER = """# Base vs SFT Model Comparison Results

**Generated:** {generated}

**Models Compared:**
- Base Model: {base_name}
- Fine-tuned Model: {sft_name}

---
"""
CMP_SIDE = """### {title} Response

```
{response}
```

**Format Check:** {status}
- Has `{reasoning_end}`: {has_reasoning_end}
- Has `{solution_start}`: {has_solution_start}
- Has `{solution_end}`: {has_solution_end}
"""
CMP_SECTION = """## Problem {problem_id}

### Problem Statement

```
{problem}
```

{base_side}
{sft_side}
### Comparison Result

{outcome}

---
"""
CMP_SUMMARY = """## Summary Statistics

| Metric | Base Model | SFT Model | Improvement |
|--------|------------|-----------|-------------|
| Correct Format | {base_correct}/{n} ({base_pct}%) | {sft_correct}/{n} ({sft_pct}%) | +{improvement} ({improvement_pct}%) |

### Key Findings

{finding}
"""
JUDGE_TITLE = {"3": "LLM Judge Evaluation Report", "4": "AI Judge Evaluation Report"}
JUDGE_HEADER = """# {title}: Base vs Fine-tuned Model

**Generated:** {generated}

## Models Evaluated

- **Base Model:** {base_name}
- **Fine-tuned Model:** {sft_name}
- **Judge Model:** {judge_name}
"""
JUDGE_SUMMARY = """## Summary Statistics

| Outcome | Count | Percentage |
|---------|-------|------------|
| **SFT Model Wins** | {sft_wins} | {sft_wins_pct}% |
| Base Model Wins | {base_wins} | {base_wins_pct}% |
| Ties | {ties} | {ties_pct}% |
{error_row}| **Total Problems** | {total} | 100% |

## Key Findings

{finding}

## Average Scores (0-10 scale)

- **Base Model:** {avg_base}
- **Fine-tuned Model:** {avg_sft}
- **Difference:** {difference}

---

## Detailed Problem-by-Problem Results
"""
JUDGE_ERROR_ROW = "| Errors | {errors} | {errors_pct}% |\n"
JUDGE_FINDING = {
    "tuned": "**Fine-tuned model outperformed base model** by {margin} problems ({margin_pct}% margin).",
    "base": "**Base model outperformed fine-tuned model** by {margin} problems ({margin_pct}% margin). "
            "This is unexpected.",
    "equal": "**Models performed equally** with {sft_wins} wins each.",
}
JUDGE_SECTION = """### Problem {problem_id}

**Problem:**
```
{question_preview}...
```

**Scores:**

{table_head}
| Base | {base_scores} | **{base_total}** |
| SFT | {sft_scores} | **{sft_total}** |

**Winner:** {winner}

**Base Model Feedback:** {judge_response_base}

**SFT Model Feedback:** {judge_response_sft}

**Reason:** {reason}

---
"""
JUDGE_TABLE_HEAD = {
    "3": "| Model | Correctness (50%) | Brevity (25%) | Clarity (25%) | **Total** |\n"
         "|-------|-------------------|---------------|---------------|--------|",
    "4": "| Model | Format | Math | Clarity | Concise | **Total** |\n"
         "|-------|--------|------|---------|---------|-------|",
}
JUDGE_CONCLUSION = {
    "tuned": "## Conclusion\n\nThe fine-tuned model demonstrates clear improvement over the base model, "
             "winning {sft_wins}/{total} comparisons ({sft_wins_pct}%).\n",
    "base": "## Conclusion\n\nThe fine-tuned model performed worse than the base model, winning only "
            "{sft_wins}/{total} comparisons ({sft_wins_pct}%). This suggests the fine-tuning may need "
            "adjustment.\n",
    "equal": "## Conclusion\n\nThe models performed comparably, each winning {sft_wins}/{total} comparisons.\n",
}
PREVIEW_CHARS = 200
# ---------------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill(template: str, **values) -> Column:
    """Literal pieces of ``template`` and the named values (Columns or str), concatenated."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(v if isinstance(v, Column) else F.lit(str(v)))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def fmt(c, pattern: str) -> Column:
    """Python-style fixed decimals (``'0'``, ``'0.0'``, ``'0.00'``; half-even)."""
    return F.call_function("format_number", c if isinstance(c, Column) else F.col(c), F.lit(pattern))


def fmt_signed(c, pattern: str = "0.00") -> Column:
    """``%+.2f``."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), fmt(c, pattern))


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def _py_bool(c: Column) -> Column:
    """Booleans as Python prints them."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def _choose(key: Column, templates: dict[str, str], **values) -> Column:
    out = None
    for k, t in templates.items():
        out = F.when(key == k, fill(t, **values)) if out is None else out.when(key == k, fill(t, **values))
    return out


def _row(df: DataFrame, block: int, text: Column, problem_id: Column | None = None) -> DataFrame:
    pid = F.lit(0).cast("bigint") if problem_id is None else problem_id.cast("bigint")
    return df.select(F.lit(block).alias("block"), pid.alias("problem_id"), text.alias("text"))


def _header(df: DataFrame, text: Column) -> DataFrame:
    """Block 0: literals only, one row that reads no input."""
    return _row(df.sparkSession.range(1), 0, text)


def comparison_report_lines(pairs: DataFrame, base_name: str, sft_name: str,
                            tags: Tags = DEFAULT_TAGS, generated: str = "") -> DataFrame:
    """Header, per-problem sections, summary table and finding (blocks 0, 1, 2)."""
    s = C.pair_summary(pairs)
    head = _header(pairs, fill(CMP_HEADER, generated=generated, base_name=base_name, sft_name=sft_name))

    def side(prefix: str, title: str) -> Column:
        fc = F.col(f"{prefix}_format_check")
        return fill(CMP_SIDE, title=title, response=F.col(f"{prefix}_response"),
                    status=F.when(fc["format_ok"], "PASS").otherwise("FAIL"),
                    reasoning_end=tags.reasoning_end, solution_start=tags.solution_start,
                    solution_end=tags.solution_end, has_reasoning_end=_py_bool(fc["has_reasoning_end"]),
                    has_solution_start=_py_bool(fc["has_solution_start"]),
                    has_solution_end=_py_bool(fc["has_solution_end"]))

    outcome = C.outcome_text(C.pair_outcome(F.col("base_format_check.format_ok"),
                                            F.col("sft_format_check.format_ok")))
    sections = _row(pairs, 1, fill(CMP_SECTION, problem_id=_s("problem_id"), problem=F.col("problem"),
                                   base_side=side("base", "BASE MODEL"), sft_side=side("sft", "SFT MODEL"),
                                   outcome=outcome), F.col("problem_id"))
    n = F.col("num_problems")
    pct = lambda c: fmt(F.try_divide(F.col(c).cast("double"), n) * 100.0, "0.0")
    finding = _choose(F.col("finding"), C.FINDING_TEXT, improvement=_s("improvement"))
    summary = _row(s, 2, fill(CMP_SUMMARY, base_correct=_s("base_model_correct"), n=_s(n),
                              base_pct=pct("base_model_correct"), sft_correct=_s("sft_model_correct"),
                              sft_pct=pct("sft_model_correct"), improvement=_s("improvement"),
                              improvement_pct=pct("improvement"), finding=finding))
    return head.unionByName(sections).unionByName(summary)


def judge_report_lines(judged: DataFrame, base_name: str, sft_name: str, judge_name: str,
                       generated: str = "", rubric: str = "3") -> DataFrame:
    """Header, summary (outcomes, finding, averages), sections, conclusion (blocks 0-3).

    ``judged`` is the unfilled judged table (``flatten_verdicts(..., fill=False)``): a missing score
    prints ``N/A`` and counts 0 in the averages. Store it first; it is read twice.
    """
    totals = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("base_total_score", "sft_total_score")]
    st = J.judge_summary(judged.select("winner", *totals))
    head = _header(judged, fill(JUDGE_HEADER, title=JUDGE_TITLE[rubric], generated=generated, base_name=base_name,
                                sft_name=sft_name, judge_name=judge_name))
    p1 = lambda c: fmt(c, "0.0")
    counts = dict(sft_wins=_s("sft_wins"), base_wins=_s("base_wins"), ties=_s("ties"),
                  errors=_s("errors"), total=_s("total_problems"), sft_wins_pct=p1("sft_wins_pct"),
                  base_wins_pct=p1("base_wins_pct"), ties_pct=p1("ties_pct"), errors_pct=p1("errors_pct"),
                  margin=_s("margin"), margin_pct=p1("margin_pct"))
    error_row = F.when(F.col("errors") > 0, fill(JUDGE_ERROR_ROW, **counts)).otherwise(F.lit(""))
    summary = fill(JUDGE_SUMMARY, error_row=error_row,
                   finding=_choose(F.col("finding"), JUDGE_FINDING, **counts),
                   avg_base=fmt("avg_base_score", "0.00"), avg_sft=fmt("avg_sft_score", "0.00"),
                   difference=fmt_signed("score_difference"), **counts)
    conclusion = _choose(F.col("finding"), JUDGE_CONCLUSION, **counts)
    blocks = F.array(F.struct(F.lit(1).alias("block"), summary.alias("text")), F.struct(F.lit(3).alias("block"), conclusion.alias("text")))
    framed = st.select(F.inline(blocks)).select("block", F.lit(0).cast("bigint").alias("problem_id"), "text")

    def na(c: str) -> Column:
        # scores print like the JSON values they came from: 8 -> "8", 7.5 -> "7.5"
        v = F.col(c)
        txt = F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
        return F.coalesce(txt, F.lit(J.NA))

    def scores(prefix: str) -> Column:
        return F.concat_ws(" | ", *[na(f"{prefix}_{c}") for c in J.CRITERIA[rubric]])

    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(J.NA))

    sections = _row(judged, 2, fill(
        JUDGE_SECTION, problem_id=_s("problem_id"), question_preview=F.substring("question", 1, PREVIEW_CHARS),
        table_head=JUDGE_TABLE_HEAD[rubric], base_scores=scores("base"), sft_scores=scores("sft"),
        base_total=fmt(F.coalesce("base_total_score", F.lit(0.0)), "0.0"),
        sft_total=fmt(F.coalesce("sft_total_score", F.lit(0.0)), "0.0"),
        winner=text_of("winner"), judge_response_base=text_of("judge_response_base"),
        judge_response_sft=text_of("judge_response_sft"), reason=text_of("reason")), F.col("problem_id"))
    return head.unionByName(framed).unionByName(sections)


def write_report(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write report blocks in order as text parts, by many tasks.

    The ranges come from blocks and problem ids alone, so the sections' texts are made once.
    """
    p = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order(lines, ["block", "problem_id"], p).select("text").write.mode("overwrite").text(path)
