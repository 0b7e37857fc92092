"""String column builders.

All are JVM-side expressions (whole-stage codegen); none is a Python UDF.
Regex patterns are Java regex; ``(?d)`` keeps ``$`` on ``\\n`` only (as in
Python) and ``(?U)`` makes ``\\s`` Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/isspace() also treats U+001C..U+001F as whitespace.
_WS = r"[\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)^{_WS}+|{_WS}+$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote_re(s: str) -> str:
    """literal-escape a tag for use inside a Java regex."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# The same set as single characters (Python str.isspace()).
WS_CHARS = ([chr(x) for x in range(0x09, 0x0E)] + [chr(x) for x in range(0x1C, 0x21)]
            + ["\x85", "\xa0", "\u1680"] + [chr(x) for x in range(0x2000, 0x200B)]
            + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])


_WS_STRING = "".join(WS_CHARS)


def strip(c) -> Column:
    """Python ``str.strip()``: ``btrim`` with the Unicode whitespace set
    (no regex; the input is referenced once)."""
    return F.btrim(col(c), F.lit(_WS_STRING))


def strip_ascii(c) -> Column:
    """Strip ASCII whitespace only (pandas numeric parsing)."""
    return F.btrim(col(c), F.lit(" \t\n\r\f\x0b"))


def remove_think_markers(c) -> Column:
    """drop every ``<think>`` and ``</think>`` marker (content stays)."""
    return F.replace(F.replace(col(c), F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))


def count_occurrences(c, tag: str) -> Column:
    """non-overlapping occurrences of a literal tag (``str.count``)."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(tag), F.lit("")))) / F.lit(len(tag))).cast("int")


def occurs_once(c, tag: str) -> Column:
    """``str.count(tag) == 1`` with two ``locate`` calls (no string copies)."""
    c = col(c)
    i = F.instr(c, tag)
    return (i > 0) & (locate_from(tag, c, i + F.lit(len(tag))) == 0)


def contains(c, tag: str) -> Column:
    """substring presence."""
    return F.instr(col(c), tag) > 0


def locate_from(sub: str, c, pos: Column) -> Column:
    """1-based position of ``sub`` in ``c`` at or after ``pos`` (0 if absent)."""
    return F.call_function("locate", F.lit(sub), col(c), pos)


def after_first(c, start: str) -> Column:
    """Text after the first ``start`` (null when absent)."""
    c = col(c)
    i = F.instr(c, start)
    return F.when(i > 0, F.substring(c, i + len(start), F.lit(2**31 - 1)))


def between_tags(c, start: str, end: str, do_strip: bool = True) -> Column:
    """first text between ``start`` and the next ``end``; null if absent.

    Equivalent to ``re.search(S(.*?)E, DOTALL).group(1)`` (then stripped),
    computed with ``instr``/``locate`` only, so it is linear in the text.
    """
    c = col(c)
    i = F.instr(c, start)
    body_from = i + F.lit(len(start))
    j = locate_from(end, c, body_from)
    body = F.when((i > 0) & (j > 0), F.substring(c, body_from, j - body_from))
    return strip(body) if do_strip else body


# --- fixed values: number patterns --------------------------------------------
#   package rule (F7): first  -?\d+\.?\d*
#   notebook rule (F8): first  -?[\d.,]+  after the solution-start tag (commas removed later)
NUMBER_RE = r"-?\d+\.?\d*"
NB_NUMBER_RE = r"-?[\d.,]+"
# ---------------------------------------------------------------------------------


def first_number(c) -> Column:
    """first ``NUMBER_RE`` match (text), null when absent."""
    return F.regexp_substr(col(c), F.lit(NUMBER_RE))


def nb_number_after(c, start: str) -> Column:
    """F8: notebook rule ``S.*?\\s*([-]?[\\d.,]+)`` -> group 1, null if absent.

    The lazy prefix means the group is the first ``-?[\\d.,]+`` run after the
    first ``start``; found with one ``regexp_substr`` on the suffix.
    """
    return F.regexp_substr(after_first(c, start), F.lit(NB_NUMBER_RE))


_WS_NOT_SPACE = "".join(ch for ch in WS_CHARS if ch != " ")


def normalize_base(c) -> Column:
    """F9, first part: strip, lower, drop ``.,!?;:`` (``translate``, no regex)."""
    return F.translate(F.lower(strip(c)), ".,!?;:", "")


def collapse_whitespace(c) -> Column:
    """F9, second part: whitespace runs to one space; the regex runs only when the
    text holds a double space or a non-space whitespace character."""
    s = col(c)
    clean = (F.instr(s, "  ") == 0) & (F.length(F.translate(s, _WS_NOT_SPACE, "")) == F.length(s))
    return F.when(clean, s).otherwise(F.regexp_replace(s, rf"(?U){_WS}+", " "))


def normalize_answer(c) -> Column:
    """strip, lower, drop ``.,!?;:``, collapse whitespace runs to one space."""
    return collapse_whitespace(normalize_base(c))


def numeric_residue(c) -> Column:
    """keep only digits, ``.`` and ``-`` (regex only when other characters occur)."""
    c = col(c)
    plain = F.length(F.translate(c, "0123456789.-", "")) == 0
    return F.when(plain, c).otherwise(F.regexp_replace(c, r"[^\d.-]", ""))


def collapse_backslashes(c) -> Column:
    """four or more backslashes -> two."""
    return F.regexp_replace(col(c), r"\\{4,}", r"\\\\")


# --- fixed values: untagged-answer phrases, in priority order (F14) --------
ANSWER_PHRASES = [
    r"The final answer is[:\s]+(.+?)(?:\.|$)",
    r"Therefore[,\s]+(.+?)(?:\.|$)",
    r"Thus[,\s]+(.+?)(?:\.|$)",
    r"The (?:dual cone|answer|solution) is[:\s]+(.+?)(?:\.|$)",
    r"In conclusion[,\s]+(.+?)(?:\.|$)",
]
# ---------------------------------------------------------------------------


def recovered_answer(c, phrases=ANSWER_PHRASES) -> Column:
    """F14 core: first phrase (priority order) that matches, group 1 stripped."""
    c = col(c)
    picks = []
    for p in phrases:
        jp = "(?isdU)" + p.replace(r"\s", _WS[1:-1])
        # group 1 is ``.+?`` (never empty), so '' means "no match": one regex per phrase
        picks.append(strip(F.nullif(F.regexp_extract(c, jp, 1), F.lit(""))))
    return F.coalesce(*picks)


def recover_untagged_answer(c, solution_start: str, solution_end: str,
                            phrases=ANSWER_PHRASES) -> Column:
    """if neither solution tag occurs, append the recovered answer wrapped in tags."""
    c = col(c)
    ans = recovered_answer(c, phrases)
    untagged = ~contains(c, solution_start) & ~contains(c, solution_end)
    return F.when(untagged & ans.isNotNull(),
                  F.concat(c, F.lit("\n" + solution_start + "\n"), ans, F.lit("\n" + solution_end))
                  ).otherwise(c)


def fence_body(c) -> Column:
    """F16: body of the first ```json fence, else of the first plain fence."""
    c = col(c)
    j = F.instr(c, "```json")
    p = F.instr(c, "```")
    after_json = F.substring(c, j + 7, F.lit(2**31 - 1))
    after_plain = F.substring(c, p + 3, F.lit(2**31 - 1))
    return (F.when(j > 0, F.substring_index(after_json, "```", 1))
             .when(p > 0, F.substring_index(after_plain, "```", 1))
             .otherwise(c))


def after_last_think(c) -> Column:
    """when both think markers occur, the stripped text after the last ``</think>``."""
    c = col(c)
    both = contains(c, "<think>") & contains(c, "</think>")
    return F.when(both, strip(F.substring_index(c, "</think>", -1))).otherwise(c)


def brace_slice(c) -> Column:
    """slice from the first ``{`` to the last ``}`` when both exist."""
    c = col(c)
    a = F.instr(c, "{")
    rb = F.instr(F.reverse(c), "}")
    b = F.length(c) - rb + 1
    return (F.when((a > 0) & (rb > 0) & (b >= a), F.substring(c, a, b - a + 1))
             .when((a > 0) & (rb > 0), F.lit(""))
             .otherwise(c))


def preview(c, n: int, suffix: str = "...") -> Column:
    """First ``n`` characters plus a suffix."""
    return F.concat(F.substring(col(c), 1, n), F.lit(suffix))


def answer_hook(c, split_marker: str | None = None) -> Column:
    """answer extractor; identity, or text after ``split_marker`` stripped."""
    c = col(c)
    if split_marker is None:
        return c
    return strip(F.get(F.split(c, F.lit(split_marker), -1), 1))


def no_spaces(c) -> Column:
    """F21 helper: remove ASCII spaces only."""
    return F.replace(col(c), F.lit(" "), F.lit(""))


def slug(c) -> Column:
    """Model-name slug, ``/`` and ``.`` -> ``_``."""
    return F.translate(col(c), "/.", "__")
