"""HTML character references decoded by Spark expressions (the rules of HTML 5, as Python's ``html.unescape`` states them).

The names and what they stand for come from the standard library's table (``html.entities.html5``), read when the expression is
built; it goes into the plan as a constant map. A text is cut at ``&``; each piece begins with a reference or does not:

* a number: the code point, with the replacements for the code points that HTML repairs or drops;
* a name of the table: its characters; else the longest name that needs no semicolon at its head, and the rest as it is;
* anything else stays as it is, with its ``&``.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col, collapse_backslashes, recover_untagged_answer

REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = 0xFFFD


@cache
def repaired() -> dict[int, int]:
    """Code points that stand for others: the C1 range reads as Windows-1252 where that has a character."""
    found = {0: REPLACEMENT, 0x0D: 0x0D}
    for n in range(0x80, 0xA0):
        try:
            found[n] = ord(bytes([n]).decode("cp1252"))
        except UnicodeDecodeError:
            found[n] = n
    return found


#: names that need no semicolon, longest first
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
BARE_HEAD = f"^(?:{'|'.join(BARE)})"


def dropped(n: Column) -> Column:
    """Code points that stand for nothing, once the repaired ones are gone: controls and noncharacters."""
    control = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F)
    return control | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)


def character(n: Column) -> Column:
    """The character of a code point (long)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _number(ref: Column) -> Column:
    """The code point of a numeric reference; one beyond Unicode for long ones."""
    def point(pattern: str, base: int) -> Column:
        digits = F.regexp_extract(ref, pattern, 1)
        return F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).when(digits == "", F.lit(0).cast("long")).otherwise(F.conv(digits, base, 10).cast("long"))

    return F.when(ref.rlike("^#[xX]"), point("^#[xX]0*([0-9a-fA-F]*)", 16)).otherwise(point("^#0*([0-9]*)", 10))


def _numeric(ref: Column) -> Column:
    n = _number(ref)
    table = F.create_map(*[F.lit(x).cast("long") for pair in repaired().items() for x in pair])
    other = F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), character(F.lit(REPLACEMENT).cast("long"))).when(dropped(n), F.lit("")).otherwise(character(n))
    return F.coalesce(character(F.try_element_at(table, n)), other)


def _named(ref: Column) -> Column:
    names = F.from_json(F.lit(_names_json()), "map<string,string>")
    head = F.regexp_extract(ref, BARE_HEAD, 0)
    bare = F.concat(F.try_element_at(names, head), F.substr(ref, F.length(head) + 1))
    return F.coalesce(F.try_element_at(names, ref), F.when(head != "", bare), F.concat(F.lit("&"), ref))


@cache
def _names_json() -> str:
    import json
    return json.dumps(html5)


def _decoded(piece: Column) -> Column:
    """What stands after an ``&``, with the reference at its head decoded."""
    ref = F.regexp_extract(piece, REFERENCE, 1)
    return F.when(ref == "", F.concat(F.lit("&"), piece)).otherwise(
        F.concat(F.when(ref.startswith("#"), _numeric(ref)).otherwise(_named(ref)), F.substr(piece, F.length(ref) + 1)))


def unescape(c) -> Column:
    """Decoded text; texts without ``&`` are passed on."""
    c = col(c)
    pieces = F.split(c, "&")
    tail = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), _decoded)
    return F.when(F.instr(c, "&") > 0, F.concat(F.get(pieces, 0), F.array_join(tail, ""))).otherwise(c)


def clean_responses(df, response: str = "response", solution_start: str = "<SOLUTION>",
                    solution_end: str = "</SOLUTION>", out: str = "cleaned"):
    """unescape entities, collapse backslash runs, recover an untagged answer
    (staged projections: each text is computed once per row)."""
    staged = df.withColumn("_h", unescape(response)).withColumn("_u", collapse_backslashes(F.col("_h")))
    return staged.withColumn(out, recover_untagged_answer(F.col("_u"), solution_start, solution_end)).drop("_h", "_u")
