"""Numeric parsing with Python / pandas rules.

``try_cast(string as double)`` is more lenient than Python's ``float``
(it accepts ``1.5d``, ``2f``, hex floats) and rejects digit underscores, so
a guard regex decides what parses, then ``try_cast`` converts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col, strip, strip_ascii

_D = r"\d(?:_?\d)*"
# Python float(): optional sign, inf/infinity/nan, decimal with digit
# underscores, optional exponent. Applied after strip().
PY_FLOAT_RE = (rf"(?i)^[+-]?(?:inf(?:inity)?|nan|{_D}(?:\.(?:{_D})?)?(?:e[+-]?{_D})?"
               rf"|\.{_D}(?:e[+-]?{_D})?)$")
_P = r"\d+"
# pandas.to_numeric: same shapes without underscores.
PD_NUMBER_RE = (rf"(?i)^[+-]?(?:inf(?:inity)?|nan|{_P}(?:\.(?:{_P})?)?(?:e[+-]?{_P})?"
                rf"|\.{_P}(?:e[+-]?{_P})?)$")
_INF_RE = r"(?i)^[+-]?inf(?:inity)?$"


_PLAIN = "0123456789.eE+-"


def py_float(c) -> Column:
    """Python ``float(text)``; null where Python raises ``ValueError``.

    Text made only of ``[0-9.eE+-]`` has the same grammar in Java and
    Python, so it is cast directly; anything else (underscores, words,
    suffixes, hex) goes through the guard regex first.
    """
    s = strip(c)
    plain = (F.length(F.translate(s, _PLAIN, "")) == 0) & (F.length(s) > 0)
    return (F.when(plain, s.try_cast("double"))
             .when(s.rlike(PY_FLOAT_RE), F.replace(s, F.lit("_"), F.lit("")).try_cast("double")))


def is_number(c) -> Column:
    """P1 predicate: ``pandas.to_numeric(errors='coerce').notnull()``.

    Keeps finite numbers and literal infinities; drops ``nan``, text,
    underscores and overflowing literals such as ``1e999``.
    """
    s = strip_ascii(c)
    v = s.try_cast("double")
    ok = s.rlike(PD_NUMBER_RE) & ~F.isnan(v)
    return F.coalesce(ok & (s.rlike(_INF_RE) | ~F.abs(v).eqNullSafe(F.lit(float("inf")))), F.lit(False))
