"""Judge prompt texts (D1, D2) and their column builder.

The templates hold four placeholders, ``<<problem>>``, ``<<ground_truth>>``,
``<<base_response>>`` and ``<<sft_response>>``; the builder splits the
template on the driver and emits one ``concat`` of literals and columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col

# --- fixed values: judge prompt texts ---------------------------------------
JUDGE_PROMPT_3 = """You are an expert judge evaluating two AI models' solutions to a convex optimization problem.

**Problem:**
<<problem>>

**Ground Truth Solution:**
<<ground_truth>>

**Model A Response (Base Model):**
<<base_response>>

**Model B Response (Fine-tuned Model):**
<<sft_response>>

**Evaluation Criteria:**

1. **Correctness** (50%): Is the solution mathematically correct compared to ground truth?
   - Check if the answer matches the ground truth
   - Verify the reasoning steps are valid
   - Assess if the approach is sound

2. **Brevity** (25%): Is the solution appropriately concise?
   - Not overly verbose
   - No unnecessary repetition
   - Gets to the point efficiently

3. **Clear Explanation** (25%): Is the reasoning clear and easy to follow?
   - Logical flow of steps
   - Well-explained reasoning
   - Easy to understand

**Your Task:**
Carefully evaluate both responses according to the criteria above. For each model:
1. Provide a score (0-10) for each criterion
2. Calculate weighted total score
3. Give brief feedback on strengths and weaknesses
4. Declare a winner

**Output Format (JSON only, no other text):**
{
  "model_a_scores": {
    "correctness": <score 0-10>,
    "brevity": <score 0-10>,
    "clear_explanation": <score 0-10>,
    "total": <weighted total 0-10>
  },
  "model_b_scores": {
    "correctness": <score 0-10>,
    "brevity": <score 0-10>,
    "clear_explanation": <score 0-10>,
    "total": <weighted total 0-10>
  },
  "model_a_feedback": "<brief feedback on strengths and weaknesses>",
  "model_b_feedback": "<brief feedback on strengths and weaknesses>",
  "winner": "<Model A|Model B|Tie>",
  "reason": "<1-2 sentence explanation of decision>"
}

Think carefully and respond ONLY with the JSON output."""

JUDGE_PROMPT_4 = """You are an expert judge evaluating two AI models' solutions to a convex optimization problem.

**Problem:**
<<problem>>

**Ground Truth Solution:**
<<ground_truth>>

**Model A Response (Base Model):**
<<base_response>>

**Model B Response (Fine-tuned Model):**
<<sft_response>>

**Evaluation Criteria:**
1. **Format Adherence** (30%): Does the response follow the required format with reasoning tags?
   - Required: `<start_working_out>...<end_working_out><SOLUTION>...</SOLUTION>`

2. **Mathematical Correctness** (40%): Is the solution mathematically sound and correct?
   - Compare with ground truth
   - Check logical reasoning steps

3. **Clarity and Completeness** (20%): Is the explanation clear and complete?
   - Are all steps explained?
   - Is the reasoning easy to follow?

4. **Conciseness** (10%): Is the solution appropriately concise without being verbose?

**Your Task:**
1. Evaluate both responses according to the criteria above
2. Provide a brief explanation for each model
3. Declare a winner (Model A, Model B, or Tie)

**Output Format (JSON):**
{
  "model_a_scores": {
    "format_adherence": <score 0-10>,
    "mathematical_correctness": <score 0-10>,
    "clarity_completeness": <score 0-10>,
    "conciseness": <score 0-10>,
    "total": <weighted total 0-10>
  },
  "model_b_scores": {
    "format_adherence": <score 0-10>,
    "mathematical_correctness": <score 0-10>,
    "clarity_completeness": <score 0-10>,
    "conciseness": <score 0-10>,
    "total": <weighted total 0-10>
  },
  "model_a_feedback": "<brief feedback>",
  "model_b_feedback": "<brief feedback>",
  "winner": "<Model A|Model B|Tie>",
  "reason": "<1-2 sentence explanation of decision>"
}

Respond ONLY with the JSON output, no other text."""

# Rubric weights stated in the prompt texts.
RUBRIC_WEIGHTS = {
    "3": {"correctness": 0.5, "brevity": 0.25, "clear_explanation": 0.25},
    "4": {"format_adherence": 0.3, "mathematical_correctness": 0.4,
          "clarity_completeness": 0.2, "conciseness": 0.1},
}
# -----------------------------------------------------------------------------

TEMPLATES = {"3": JUDGE_PROMPT_3, "4": JUDGE_PROMPT_4}
_PH = re.compile(r"<<(problem|ground_truth|base_response|sft_response)>>")


def fill_template(template: str, **cols) -> Column:
    """Literal pieces and the named columns, concatenated in template order."""
    parts, pos = [], 0
    for m in _PH.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(col(cols[m.group(1)]))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def judge_prompt(problem, ground_truth, base_response, sft_response, rubric: str = "3") -> Column:
    """D1 (three criteria) / D2 (four criteria) judge prompt."""
    return fill_template(TEMPLATES[rubric], problem=problem, ground_truth=ground_truth,
                         base_response=base_response, sft_response=sft_response)
