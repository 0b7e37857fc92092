"""DuckDB SQL expression builders for the oracle queries.

Independent SQL formulations of the same rules (RE2 regex, DuckDB string
functions); used only to cross-check the Spark operators.
"""

from __future__ import annotations

from tessera.functions.tags import DEFAULT_TAGS as TG

# Python str.isspace() set, spelled for RE2.
WS = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_ascii(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


def between(x: str, s: str, e: str, do_strip: bool = True) -> str:
    rest = f"substr({x}, instr({x}, {q(s)}) + {len(s)})"
    body = (f"(case when instr({x}, {q(s)}) > 0 and instr({rest}, {q(e)}) > 0 "
            f"then substr({rest}, 1, instr({rest}, {q(e)}) - 1) end)")
    return strip(body) if do_strip else body


_D = r"\d(?:_?\d)*"
PY_FLOAT_RE = (rf"(?i)[+-]?(?:inf(?:inity)?|nan|{_D}(?:\.(?:{_D})?)?(?:e[+-]?{_D})?"
               rf"|\.{_D}(?:e[+-]?{_D})?)")
PD_NUM_RE = r"(?i)[+-]?(?:inf(?:inity)?|\d+(?:\.(?:\d+)?)?(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?)"
INF_RE = r"(?i)[+-]?inf(?:inity)?"


def py_float(x: str) -> str:
    s = strip(x)
    return (f"(case when regexp_full_match({s}, '{PY_FLOAT_RE}') "
            f"then try_cast(replace({s}, '_', '') as double) end)")


def is_number(x: str) -> str:
    s = strip_ascii(x)
    return (f"coalesce(regexp_full_match({s}, '{PD_NUM_RE}') and (regexp_full_match({s}, '{INF_RE}') "
            f"or abs(try_cast({s} as double)) < 'inf'::double), false)")


def count_occ(x: str, t: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(t)}, ''))) // {len(t)})"


def contains(x: str, t: str) -> str:
    return f"(instr({x}, {q(t)}) > 0)"


def normalize(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower({strip(x)}), '[.,!?;:]', '', 'g'), "
            f"'{WS}+', ' ', 'g')")


def residue(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9.-]', '', 'g')"


def tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\w+|[^\w\s]'))"


def render_head_default() -> str:
    return q(TG.system_prompt + TG.eos)


def sys_user_prompt(user: str) -> str:
    """[system, user] rendered with the generation prompt."""
    return f"({q(TG.system_prompt + TG.eos)} || {user} || {q(TG.reasoning_start)})"


def sft_assistant(answer: str, solution: str) -> str:
    thoughts = strip(f"replace(replace({solution}, '<think>', ''), '</think>', '')")
    return (f"({q(TG.reasoning_start)} || {thoughts} || {q(TG.reasoning_end + TG.solution_start)} "
            f"|| {answer} || {q(TG.solution_end)})")


def sft_text(problem: str, answer: str, solution: str) -> str:
    return (f"({q(TG.system_prompt + TG.eos)} || {problem} || {sft_assistant(answer, solution)} "
            f"|| {q(TG.eos)})")
