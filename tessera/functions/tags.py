"""Formatting tags and the system prompt.

The tags and prompt template are job constants; they are folded into
column expressions as literals, never stored as a column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values (must equal the reference's defaults) ---------------------
# Tags: <start_working_out>  <end_working_out>  <SOLUTION>  </SOLUTION>
# System prompt template (lines joined by "\n", no trailing newline):
#   You are given a problem.
#   Think about the problem and provide your working out.
#   Place it between {reasoning_start} and {reasoning_end}.
#   Then, provide your solution between {solution_start}{solution_end}
# Judge defaults: missing ground truth -> "Ground truth not found";
# missing verdict text -> "N/A"; failed verdict -> winner "Error".
REASONING_START = "<start_working_out>"
REASONING_END = "<end_working_out>"
SOLUTION_START = "<SOLUTION>"
SOLUTION_END = "</SOLUTION>"
SYSTEM_PROMPT_TEMPLATE = (
    "You are given a problem.\n"
    "Think about the problem and provide your working out.\n"
    "Place it between {reasoning_start} and {reasoning_end}.\n"
    "Then, provide your solution between {solution_start}{solution_end}"
)
# The end-of-sequence marker comes from the tokenizer in use; this default is
# the base model family's end-of-text token and is a parameter everywhere.
DEFAULT_EOS = "<|endoftext|>"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Tags:
    reasoning_start: str = REASONING_START
    reasoning_end: str = REASONING_END
    solution_start: str = SOLUTION_START
    solution_end: str = SOLUTION_END
    eos: str = DEFAULT_EOS
    system_prompt_template: str = SYSTEM_PROMPT_TEMPLATE

    @property
    def system_prompt(self) -> str:
        """Template with the four tags substituted (driver-side, constant-folded)."""
        return self.system_prompt_template.format(
            reasoning_start=self.reasoning_start,
            reasoning_end=self.reasoning_end,
            solution_start=self.solution_start,
            solution_end=self.solution_end,
        )

    def components(self) -> dict[str, str]:
        return {
            "reasoning_start": self.reasoning_start,
            "reasoning_end": self.reasoning_end,
            "solution_start": self.solution_start,
            "solution_end": self.solution_end,
        }

    def with_(self, **kw) -> "Tags":
        return replace(self, **kw)


DEFAULT_TAGS = Tags()
