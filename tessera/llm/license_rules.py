"""License scans by ordered signature rules.

A rule is a hand-written regex over the words of a text, written as words: ``[x]`` is a word that may be
missing, ``...3`` stands for up to three words, and each word is a small regex of its own.
``RULES`` holds them in order: texts of notices first, then statements that name a license, identifiers and
addresses, names, and last single clauses. A rule's priority is the level it stands in.

1. *Normal form*. A-Z lower-cased, words with a blank on each side of their own, so a regex
   matches whole words only and neighbouring matches share nothing.
2. *Prefilter*. Each rule has a keyword, which every match of it holds. A rule is tried on a text only if the
   keyword is in it; a text without any keyword of a rule gets no regex at all.
3. *Places*. What lies between a rule's matches gives the position of each in words: running sums by a window
   over (document, rule). Texts are not shuffled, only a few numbers for each place found.
4. *Suppression*. Places of a document in order of their start, longest first: one contained in a place
   of higher priority, or in a longer one of equal priority, or in an equal one of an earlier rule, is dropped. Running
   maxima of the ends give this in one pass; overlaps that are no containment stay both.

A document's places meet in one task: they are a few numbers each, and no more than its words. Everything is
built-in column functions.

Defined results: null, empty and word-less texts have no words and no places; repeated rows are
scanned each for itself; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common as C

#: fixed values: what separates words, after lower-casing
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STEM = "licen"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """label, keyword (words that every match holds), pattern (a regex over the normal form), priority (0 is highest), strength of the evidence, base."""

    label: str
    keyword: str
    pattern: str
    priority: int
    strength: float
    base: bool = False


def compiled(words: str) -> str:
    """The regex of a rule over the normal form, in which each word has a blank on each side of its own."""
    out = []
    for w in words.split():
        if gap := re.fullmatch(r"\.\.\.(\d+)", w):
            out.append(f"(?: [^ ]+ ){{0,{gap[1]}}}")
        elif optional := re.fullmatch(r"\[(.+)\]", w):
            out.append(f"(?: (?:{optional[1]}) )?")
        else:
            out.append(f" (?:{w}) ")
    return "".join(out)


# The rules, written as words; (label, keyword, words). Separators are no words: "2.0" is "2 0", "GPL-3.0" is "gpl 3 0".

#: phrases that always count
BASE = [
    ("cc-by", " cc by ", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
]

#: names of licenses: label, keyword, name, identifier (or ""), address (or "")
NAMES = [
    ("mit", "mit", "mit licen[sc]e", "mit", "opensource org licenses mit"),
    ("mit-0", "attribution", "mit no attribution [licen[sc]e]", "mit 0", ""),
    ("x11", "x11", "x11 licen[sc]e", "x11", ""),
    ("isc", "isc", "isc licen[sc]e", "isc", "opensource org licenses isc"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd) bsd licen[sc]e|2 clause bsd licen[sc]e|bsd 2 clause [licen[sc]e]", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd licen[sc]e|3 clause bsd licen[sc]e|bsd 3 clause [licen[sc]e]", "bsd 3 clause",
     "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|old) bsd licen[sc]e|4 clause bsd licen[sc]e|bsd 4 clause [licen[sc]e]", "bsd 4 clause", ""),
    ("0bsd", "bsd", "zero clause bsd [licen[sc]e]|0 clause bsd [licen[sc]e]", "0bsd", ""),
    ("bsd", "bsd", "bsd (?:style|licen[sc]e|licen[sc]ed)", "", ""),
    ("apache-1.1", "apache", "apache [software] licen[sc]e [version|v] 1 1", "apache 1 1", ""),
    ("apache-2.0", "apache", "apache [software] licen[sc]e [version|v] (?:2|v2) [0]", "apache 2 0", "apache org licenses licen[sc]e 2 0"),
    ("apache", "apache", "apache [software] licen[sc]e", "", "apache org licenses"),
    ("gpl-1.0", "general public", "gnu general public licen[sc]e [version|v] (?:1|v1) [0]", "gpl 1 0 [only|or] [later]", ""),
    ("gpl-2.0", "general public", "[gnu] general public licen[sc]e [version|v] (?:2|v2) [0]", "gpl 2 0 [only|or] [later]", "gnu org licenses old licenses gpl 2 0|gnu org licenses gpl 2 0"),
    ("gpl-3.0", "general public", "[gnu] general public licen[sc]e [version|v] (?:3|v3) [0]", "gpl 3 0 [only|or] [later]", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu", "gnu gpl|gnu general public licen[sc]e", "", "gnu org licenses gpl"),
    ("lgpl-2.0", "library general", "[gnu] library general public licen[sc]e ...1 (?:2|v2) [0]", "lgpl 2 0 [only|or] [later]", ""),
    ("lgpl-2.1", "lesser general", "[gnu] lesser general public licen[sc]e ...1 (?:2|v2) 1", "lgpl 2 1 [only|or] [later]", "gnu org licenses old licenses lgpl 2 1|gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "lesser general", "[gnu] lesser general public licen[sc]e ...1 (?:3|v3) [0]", "lgpl 3 0 [only|or] [later]", "gnu org licenses lgpl 3 0"),
    ("lgpl", "general public", "[gnu] (?:lesser|library) general public licen[sc]e", "", "gnu org licenses lgpl"),
    ("agpl-3.0", "affero", "[gnu] affero general public licen[sc]e [version|v] (?:3|v3) [0]", "agpl 3 0 [only|or] [later]", "gnu org licenses agpl 3 0"),
    ("agpl", "affero", "[gnu] affero general public licen[sc]e", "", "gnu org licenses agpl"),
    ("gfdl-1.3", "documentation", "[gnu] free documentation licen[sc]e [version|v] 1 3", "gfdl 1 3", ""),
    ("gfdl", "documentation", "[gnu] free documentation licen[sc]e", "gfdl 1 2", "gnu org licenses fdl"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e [version|v] 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e [version|v] (?:2|v2) [0]", "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "", "mozilla org mpl"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e ...1 (?:1|v1) [0]", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e ...1 (?:2|v2) [0]", "epl 2 0", "eclipse org legal epl 2 0"),
    ("epl", "eclipse", "eclipse public licen[sc]e", "", ""),
    ("edl-1.0", "eclipse", "eclipse distribution licen[sc]e ...1 [1|v1] [0]", "", ""),
    ("cddl-1.0", "common development", "common development and distribution licen[sc]e ...1 1 0", "cddl 1 0", ""),
    ("cddl-1.1", "common development", "common development and distribution licen[sc]e ...1 1 1", "cddl 1 1", ""),
    ("cddl", "common development", "common development and distribution licen[sc]e", "", ""),
    ("cpl-1.0", "common public", "common public licen[sc]e ...1 [1] [0]", "cpl 1 0", ""),
    ("ipl-1.0", "ibm", "ibm public licen[sc]e ...1 [1] [0]", "ipl 1 0", ""),
    ("bsl-1.0", "boost", "boost software licen[sc]e ...1 [1] [0]", "bsl 1 0", "boost org license 1 0"),
    ("zlib", "zlib", "zlib [libpng] licen[sc]e", "zlib", "zlib net zlib license"),
    ("libpng", "libpng", "libpng licen[sc]e [version] [2]", "libpng 2 0", ""),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl", ""),
    ("curl", "curl", "curl licen[sc]e", "curl", ""),
    ("artistic-1.0", "artistic", "artistic licen[sc]e ...1 1 0", "artistic 1 0", ""),
    ("artistic-2.0", "artistic", "artistic licen[sc]e ...1 (?:2|v2) [0]", "artistic 2 0", ""),
    ("artistic", "artistic", "[perl|clarified] artistic licen[sc]e", "", ""),
    ("afl-3.0", "academic", "academic free licen[sc]e ...1 [3] [0]", "afl 3 0", ""),
    ("osl-3.0", "open software", "open software licen[sc]e ...1 [3] [0]", "osl 3 0", ""),
    ("ecl-2.0", "educational", "educational community licen[sc]e ...1 [2] [0]", "ecl 2 0", ""),
    ("eupl-1.1", "european", "european union public licen[sc]e ...1 1 1", "eupl 1 1", ""),
    ("eupl-1.2", "european", "european union public licen[sc]e ...1 1 2", "eupl 1 2", ""),
    ("eupl", "european", "european union public licen[sc]e", "", ""),
    ("cecill-2.1", "cecill", "cecill [free] [software] licen[sc]e [agreement] ...1 2 1", "cecill 2 1", ""),
    ("cecill", "cecill", "cecill [free] [software] [licen[sc]e]", "cecill (?:b|c)", ""),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", "ms pl", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", "ms rl", ""),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql", ""),
    ("python-2.0", "python", "python software foundation licen[sc]e [agreement] [version] [2]|python licen[sc]e [agreement] [version] [2]", "psf 2 0|python 2 0", "docs python org license"),
    ("php-3.01", "php", "php licen[sc]e ...1 3 01", "php 3 01", ""),
    ("php", "php", "php licen[sc]e", "php 3 0", "php net license"),
    ("ruby", "ruby", "ruby [s] licen[sc]e", "ruby", ""),
    ("vim", "vim", "vim licen[sc]e", "vim", ""),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[sc]e", "wtfpl", "wtfpl net"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("ncsa", "illinois", "university of illinois ...2 open source licen[sc]e", "ncsa", ""),
    ("w3c", "w3c", "w3c [r] [software] [notice] [and] licen[sc]e", "w3c", ""),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", "sleepycat", ""),
    ("qpl-1.0", "q public", "q public licen[sc]e ...1 [1] [0]", "qpl 1 0", ""),
    ("ofl-1.1", "sil", "sil open font licen[sc]e ...1 [1] [1]", "ofl 1 1", "scripts sil org ofl"),
    ("lppl-1.3c", "latex", "latex project public licen[sc]e ...1 1 3c?", "lppl 1 3c", ""),
    ("lppl", "latex", "latex project public licen[sc]e", "", "latex project org lppl"),
    ("upl-1.0", "universal permissive", "universal permissive licen[sc]e ...1 [1] [0]", "upl 1 0", ""),
    ("busl-1.1", "business source", "business source licen[sc]e ...1 [1] [1]", "busl 1 1", ""),
    ("sspl-1.0", "server side", "server side public licen[sc]e ...1 [1|v1] [0]", "sspl 1 0", ""),
    ("elastic-2.0", "elastic", "elastic licen[sc]e ...1 [2|v2] [0]", "elastic 2 0", ""),
    ("commons-clause", "commons clause", "commons clause [licen[sc]e] [condition]", "", "commonsclause com"),
    ("polyform", "polyform", "polyform (?:noncommercial|shield|strict) licen[sc]e|polyform small business licen[sc]e|polyform internal use licen[sc]e", "polyform noncommercial 1 0 0", ""),
    ("bigscience-rail", "rail", "[bigscience] (?:open|creative)?rail [m] licen[sc]e", "", ""),
    ("llama", "llama", "llama [2|3] community licen[sc]e [agreement]", "", ""),
    ("json", "json", "json licen[sc]e", "json", ""),
    ("beerware", "beer", "beer ware licen[sc]e|beerware [licen[sc]e]", "beerware", ""),
    ("odbl-1.0", "open database", "open database licen[sc]e ...1 [1|v1] [0]", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open data commons", "open data commons attribution licen[sc]e ...1 [1|v1] [0]", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", "dedication", "[open] [data] [commons] public domain dedication and licen[sc]e", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("cdla-permissive", "community data", "community data licen[sc]e agreement ...1 permissive ...1 [1|2] [0]", "cdla permissive (?:1|2) 0", ""),
    ("ogl-uk", "open government", "[uk] open government licen[sc]e ...1 [1|2|3|v1|v2|v3] [0]", "ogl uk (?:1|2|3) 0", "nationalarchives gov uk doc open government licence"),
    ("etalab", "etalab", "etalab open licen[sc]e|licence ouverte etalab", "etalab 2 0", ""),
    ("dl-de-by", "datenlizenz", "datenlizenz deutschland [namensnennung|zero] ...2", "dl de by 2 0", ""),
]

#: Creative Commons: label, what follows "creative commons" in words, short name, path of the address
CREATIVE = [
    ("cc-by-nc-nd", "attribution noncommercial (?:noderivs|noderivatives)|attribution non commercial no (?:derivs|derivatives)", "by nc nd", "by nc nd"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike|attribution non commercial share alike", "by nc sa", "by nc sa"),
    ("cc-by-nc", "attribution noncommercial|attribution non commercial", "by nc", "by nc"),
    ("cc-by-nd", "attribution (?:noderivs|noderivatives)|attribution no (?:derivs|derivatives)", "by nd", "by nd"),
    ("cc-by-sa", "attribution sharealike|attribution share alike", "by sa", "by sa"),
    ("cc-by", "attribution|by", "by", "by"),
    ("cc0", "zero|0", "0", "zero"),
    ("cc-pd", "public domain mark", "pdm", "mark"),
]

#: texts of notices and single clauses: label, keyword, words
NOTICES = [
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "neither the name of ...12 may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "express or implied", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "received a copy", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received a copy", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "affero", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("zlib", "origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want to", "you just do what the fuck you want to"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license"),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic-2.0", "artistic", "this is free software you can redistribute it and or modify it under the terms of the artistic license"),
    ("ecl-2.0", "educational", "licensed under the educational community license version 2 0"),
    ("postgresql", "without fee", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ncsa", "with the software", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("cc0", "dedicated", "has dedicated the work to the public domain by waiving all of his or her rights"),
    ("ms-pl", "accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("sspl-1.0", "server side", "under the terms of the server side public license"),
    ("busl-1.1", "production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
]

#: statements that no license is named in: label, keyword, words
CLAUSES = [
    ("reserved", "some rights reserved", "some rights reserved"),
    ("reserved", "rights reserved", "no rights reserved"),
    ("reserved", "droits", "tous droits réservés"),
    ("reserved", "rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", "derechos", "todos los derechos reservados"),
    ("copyright", "copyright", "copyright [c] (?:19|20)[0-9][0-9] ...3"),
    ("copyright", "copyright", "copyright (?:holder|holders|owner|owners|notice)"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain (?:work|dedication|mark|software|notice)"),
    ("proprietary", "proprietary", "(?:proprietary|confidential) and (?:proprietary|confidential)"),
    ("proprietary", "proprietary", "proprietary (?:licen[sc]e|software|information)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) ...8 prohibited"),
    ("proprietary", "without the prior", "without the prior written (?:permission|consent) of"),
    ("proprietary", "end user", "end user licen[sc]e agreement"),
    ("non-commercial", "non commercial", "non commercial (?:use|purposes) [only]"),
    ("non-commercial", "use only", "for (?:personal|private|academic|research|educational) ...3 use only"),
    ("non-commercial", "noncommercial", "[for] noncommercial (?:use|purposes) [only]"),
    ("warranty-disclaimer", "as is", "provided ...5 as is"),
    ("warranty-disclaimer", "warranty", "without warranty of any kind"),
    ("dual-license", "dual", "dual licen[sc]ed"),
    ("open-source", "open source", "open source licen[sc]es?"),
    ("license-reference", "licen", "see [the] licen[sc]e [file] [for] [details]"),
    ("license-reference", "licen", "licen[sc]e (?:file|txt|md)"),
    ("license-statement", "licensed under", "licensed under [the] ...3 (?:licen[sc]e|terms)"),
    ("license-statement", "released under", "released under [the] ...3 (?:licen[sc]e|terms)"),
    ("license-statement", "distributed under", "distributed under [the] ...3 (?:licen[sc]e|terms)"),
    ("license-statement", "terms of the", "under the terms of the ...4 licen[sc]e"),
]

#: what stands before a name in a statement
STATEMENT = "(?:licen[sc]ed|released|distributed|published|available|covered|provided|redistributed) under [the] [terms] [of] [a] [the] [gnu]"


def alternatives(words: str) -> list[str]:
    """A rule's alternatives on the top level, which are rules of their own."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(words):
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and not depth:
            out.append(words[last:i])
            last = i + 1
    return [*out, words[last:]]


def creative(short: str) -> str:
    """The short name of a Creative Commons license in words."""
    return "cc0 [1] [0]" if short == "0" else f"cc {short} [1|2|3|4] [0|5]"


def _rules() -> list[Rule]:
    found: list[Rule] = []

    def add(level: int, strength: float, label: str, keyword: str, words: str, base: bool = False):
        for alternative in alternatives(words):
            found.append(Rule(label, keyword, compiled(alternative), level, strength, base))

    for label, keyword, words in NOTICES:
        add(0, 1.0, label, keyword, words)
    for label, _, short, _ in CREATIVE:
        add(1, 0.95, label, " cc", f"(?:licen[sc]ed|released|published|available) under [a|the] {creative(short)}")
    for label, keyword, name, identifier, _ in NAMES:
        for n in alternatives(name):
            add(1, 0.95, label, keyword, f"{STATEMENT} {n}")
        if identifier:
            for i in alternatives(identifier):
                add(1, 0.95, label, "spdx", f"spdx licen[sc]e identifier {i}")
    for label, _, short, path in CREATIVE:
        add(2, 0.9, label, "creativecommons", f"creativecommons org (?:licenses|publicdomain) {path} [1|2|3|4] [0|5]")
        add(2, 0.9, label, " cc", creative(short))
    for label, _, _, _, address in NAMES:
        for a in alternatives(address) if address else ():
            add(2, 0.9, label, " ".join(a.split()[:2]), a)
    for label, words, _, _ in CREATIVE:
        for alternative in alternatives(words):
            add(2, 0.9, label, "creative commons", f"creative commons {alternative} [1|2|3|4|international|generic|unported] [0|5] [international|generic|unported] [public] [licen[sc]e]")
    for label, keyword, name, _, _ in NAMES:
        add(3, 0.8, label, keyword, name)
    for label, keyword, words in BASE:
        add(4, 0.7, label, keyword, words, True)
    add(4, 0.6, "creative-commons", "creative commons", "creative commons licen[sc]e")
    for label, keyword, words in CLAUSES:
        add(5, 0.4, label, keyword, words)
    return found


RULES = _rules()
LEVELS = max(r.priority for r in RULES) + 1


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normal_form(text: Column) -> Column:
    """The words of a text, lower-cased, each with a blank on either side; empty without words."""
    words = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def word_count(normal: Column) -> Column:
    """Each word has two blanks of its own."""
    return F.floor((F.char_length(normal) - F.char_length(F.replace(normal, F.lit(" "), F.lit("")))) / 2).cast("int")


def keyword_form(keyword: str) -> str:
    """A keyword as it stands in the normal form; its ends may be parts of words, unless it begins or ends with a blank."""
    return keyword.strip().replace(" ", "  ").join((" " * keyword.startswith(" "), " " * keyword.endswith(" ")))


OPTIONAL = re.compile(r"\(\?: \(\?:.*?\) \)\?")


def holds_stem(rule: Rule) -> bool:
    """Whether each match of a rule holds ``STEM``: a word that may not be missing begins so."""
    return f" (?:{STEM}" in OPTIONAL.sub("", rule.pattern)


def places(text: str, rules: list[Rule]) -> Column:
    """An array of (rule, gap, length), per rule in order: the words between a match and the one before, its words; first (-1, 0, 0).

    ``text`` names the column. A text is searched for a rule's matches only if the rule's keyword is in it; most
    rules name a license, and their keywords are sought only in texts that hold ``STEM``. The expression
    is written as SQL, since it has thousands of parts.
    """
    none = "cast(array() as array<struct<rule:int,gap:int,length:int>>)"

    def n_words(x: str) -> str:
        return f"(char_length({x}) - char_length(replace({x}, ' ', ''))) div 2"

    def matches(k: int) -> str:
        gaps = f"transform(split({text}, '{rules[k].pattern}'), x -> int({n_words('x')}))"
        found = f"transform(regexp_extract_all({text}, '{rules[k].pattern}', 0), x -> int({n_words('x')}))"
        # the last gap follows the last match
        return f"filter(zip_with({gaps}, {found}, (g, n) -> named_struct('rule', {k}, 'gap', g, 'length', n)), x -> x.length is not null)"

    def gated(numbers: list[int]) -> str:
        by_keyword: dict[str, list[int]] = {}
        for k in numbers:
            by_keyword.setdefault(rules[k].keyword, []).append(k)
        parts = [f"if(contains({text}, '{keyword_form(word)}'), concat({', '.join(map(matches, own))}), {none})" for word, own in by_keyword.items()]
        return f"concat({', '.join([none, *parts])})"

    stem = [k for k, r in enumerate(rules) if holds_stem(r)]
    rest = [k for k, r in enumerate(rules) if not holds_stem(r)]
    return F.expr(f"concat(array(named_struct('rule', -1, 'gap', 0, 'length', 0)), if(contains({text}, '{STEM}'), {gated(stem)}, {none}), {gated(rest)})")


def detections(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row_id, doc_id, n_words, rule (number), label, priority, strength, base, start, length (in words), kept (false if suppressed) of each place
    that a rule matches, and of each document a row with the rule -1."""
    rules = RULES if rules is None else rules
    own = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), normal_form(F.col(text)).alias("words"))
    found = own.select("row_id", "doc_id", word_count(F.col("words")).cast("long").alias("n_words"), places("words", rules).alias("places"))
    rows = found.select("row_id", "doc_id", "n_words", F.posexplode("places").alias("i", "p")).select("row_id", "doc_id", "n_words", "i", "p.*")
    rows = rows.repartition("row_id")  # both windows and the caller's grouping stay within it
    before = Window.partitionBy("row_id", "rule").orderBy("i")
    rows = rows.withColumn("start", (F.sum(F.col("gap") + F.col("length")).over(before) - F.col("length")).cast("long")).drop("gap", "i")

    def fact(name: str, values: list[str]) -> Column:
        return F.expr(f"element_at(array({', '.join(['null', *values])}), rule + 2)").alias(name)

    rows = rows.select("*", fact("label", [f"'{r.label}'" for r in rules]), fact("priority", [str(r.priority) for r in rules]),
                       fact("strength", [f"{r.strength}D" for r in rules]), fact("base", [str(r.base).lower() for r in rules]))
    end = F.col("start") + F.col("length")
    # of equal places the earlier rule comes first; a place is contained in an earlier one that reaches as far
    order = Window.partitionBy("row_id").orderBy(F.col("start"), end.desc(), F.col("rule")).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in range(LEVELS):
        reach = F.max(F.when(F.col("priority") == level, end)).over(order)
        covered = covered | ((F.col("priority") >= level) & F.coalesce(reach >= end, F.lit(False)))
    return rows.withColumn("kept", (F.col("rule") >= 0) & ~covered)


def scan(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places, n_suppressed of each document, from its places.

    Base rules keep their labels where they are suppressed; score is the strength of the best rule kept.
    """
    rows = detections(docs, rules, text, doc_id)
    base = F.col("base")

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    out = rows.groupBy("row_id", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(base | F.col("kept")).alias("labels"),
        F.coalesce(F.max(F.when(base | F.col("kept"), F.col("strength"))), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("rule") >= 0, 1)).alias("n_places"), F.count(F.when(~F.col("kept") & (F.col("rule") >= 0), 1)).alias("n_suppressed"))
    return out.drop("row_id")
