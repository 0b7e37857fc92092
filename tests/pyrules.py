"""Plain-Python statements of the scoring rules, written independently as a
test oracle for the Spark columns (row at a time, standard library only)."""

from __future__ import annotations

import math
import re

RS, RE_, SS, SE = "<start_working_out>", "<end_working_out>", "<SOLUTION>", "</SOLUTION>"
EOS = "<|endoftext|>"


def to_float(s):
    try:
        return float(s)
    except (ValueError, TypeError):
        return None


def first_between(text, a, b):
    m = re.search(re.escape(a) + r"(.*?)" + re.escape(b), text, re.DOTALL)
    return m.group(1) if m else None


EXACT = re.compile(re.escape(RS) + r".*?" + re.escape(RE_) + re.escape(SS) + r".*?" + re.escape(SE), re.DOTALL)


def exact_format(text):
    return 3.0 if EXACT.search(text) else 0.0


def approx_format(text):
    return sum(0.5 if text.count(t) == 1 else -1.0 for t in (RE_, SS, SE))


def band(r, close, near, other):
    if 0.9 <= r <= 1.1:
        return close
    if 0.8 <= r <= 1.2:
        return near
    return other


def answer_score(text, expected):
    body = first_between(text, SS, SE)
    if body is None:
        return -2.0
    got = body.strip()
    if got == expected:
        return 5.0
    if got.replace(" ", "") == expected.replace(" ", ""):
        return 3.5
    x, e = to_float(got), to_float(expected)
    if x is None or e is None:
        return -2.5
    if e == 0:
        return 5.0 if x == 0 else -2.5
    return band(x / e, 2.0, 1.5, -2.5)


def numbers_score(text, expected):
    body = first_between(text, SS, SE)
    if body is None:
        return -1.5
    m = re.search(r"-?\d+\.?\d*", body.strip(), flags=re.ASCII)
    e = to_float(expected)
    if m is None or e is None:
        return -1.5
    x = float(m.group(0))
    if e == 0:
        return 4.0 if x == 0 else -2.0
    if abs(x - e) < 1e-6:
        return 4.0
    return band(x / e, 2.5, 1.5, -2.0)


NB_FORMAT = re.compile(re.escape(RE_) + r".*?" + re.escape(SS) + r"(.+?)" + re.escape(SE)
                       + r"[\s]{0,}(?:" + re.escape(EOS) + r")?[\s]{0,}$", re.M | re.S)


def nb_exact(text):
    return 3.0 if NB_FORMAT.search(text) else 0.0


def nb_answer(text, expected):
    m = NB_FORMAT.search(text)
    if m is None:
        return -2.0
    g = m.group(1)
    if g == expected:
        return 5.0
    if g.strip() == expected.strip():
        return 3.5
    x, e = to_float(g), to_float(expected)
    if x is None or e is None or e == 0:
        return -4.5
    return band(x / e, 2.0, 1.5, -2.5)


def nb_numbers(text, expected):
    i = text.find(SS)
    if i < 0:
        return -2.5
    m = re.search(r"-?[0-9.,]+", text[i + len(SS):])
    if m is None:
        return -2.5
    x, e = to_float(m.group(0).replace(",", "")), to_float(expected)
    if x is None or e is None:
        return 0.0
    return 3.5 if x == e else -1.5


def same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return a == b
