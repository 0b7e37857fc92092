"""License scan, spelling variants and source audit against brute force; edge tables and planted cases of the fitted and parsing operators."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, hashing, html_template, license_rules, quality_crf, secret_forest, source_audit, spelling_variants, toxicity
from tessera.llm.common import table

from .test_operators import SF, docs, empty, html_texts, pairs  # noqa: F401

SF01 = "/root/testdata/sf0.1"


# license scan

def test_every_rule_has_its_keyword_in_each_match():
    """Examples of each rule, with and without its optional words, hold its keyword; the stem gate is sound."""
    def examples(pattern):
        for optional in ("", None):
            out = re.sub(r"\(\?: \(\?:([^()]*(?:\([^()]*\)[^()]*)*)\) \)\?", lambda m: "" if optional == "" else f" {m[1]} ", pattern)
            out = re.sub(r"\(\?: \[\^ \]\+ \)\{0,\d+\}", "" if optional == "" else " word ", out)
            out = re.sub(r"\[(.)[^]]*\]", r"\1", out).replace("$", "")
            for _ in range(4):
                out = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", out)
            out = re.sub(r"(\w)\?", "", out)
            yield re.sub(r" (\w+)\|[\w|]*", r" \1", out)

    assert len(license_rules.RULES) > 200 and [r.priority for r in license_rules.RULES] == sorted(r.priority for r in license_rules.RULES)
    checked = 0
    for rule in license_rules.RULES:
        for text in examples(rule.pattern):
            for m in re.finditer(rule.pattern, text):
                checked += 1
                assert license_rules.keyword_form(rule.keyword) in m[0], (rule, m[0])
                assert not license_rules.holds_stem(rule) or license_rules.STEM in m[0]
    assert checked > 1.5 * len(license_rules.RULES)


def scanned(text):
    """What the scan finds in a text, place by place."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    normal = "".join(f" {w} " for w in words)
    found = []
    for k, r in enumerate(license_rules.RULES):
        for m in re.finditer(r.pattern, normal):
            start, length = normal[:m.start()].count(" ") // 2, m[0].count(" ") // 2
            found.append((start, -(start + length), k, r))
    kept = [a for a in found if not any((b[0], b[1], b[2]) != (a[0], a[1], a[2]) and b[0] <= a[0] and b[1] <= a[1] and b[3].priority <= a[3].priority
                                        and ((b[0], b[1]) != (a[0], a[1]) or b[2] < a[2]) for b in found)]
    base = [a for a in found if a[3].base]
    starts = [a[0] for a in base]
    counted = {a[2:3] + a[:2]: a[3] for a in [*kept, *base]}.values()
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({a[3].label for a in base})),
            ",".join(sorted({r.label for r in counted})), max((r.strength for r in counted), default=0.0), len(found), len(found) - len(kept))


def test_license_scan_is_exact(spark, docs, empty):  # noqa: F811
    r = random.Random(7)
    lines = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "ALL RIGHTS\nRESERVED", "all rights reservedé", "cc by cc by cc-by", "GNU General Public License, version 3.",
             "SPDX-License-Identifier: Apache-2.0", "https://www.apache.org/licenses/LICENSE-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             "creativecommons.org/licenses/by-sa/4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "Copyright (c) 2019 Some One Else", "some ccby words",
             "provided by the holders and contributors as is", "K general public license", "See the LICENSE file for details", "dual licensed", "mit mit licence", "x" * 300]
    texts = [None, "", " \n", "license", *lines] + [" ".join(r.choice([*lines, "plain words here"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, rule string, words int").repartition(5)
    got = {x["doc_id"]: tuple(x)[1:] for x in license_rules.scan(frame).collect()}
    assert got == {i: scanned(t) for i, t in enumerate(texts)}
    assert license_rules.scan(empty).collect() == [] and license_rules.scan(docs).count() == docs.count()


# spelling variants

def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants_of(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if near_words(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            top = min(near[w], key=lambda v: (-n[v], v))
            if n[top] >= 5 * n[w]:
                form[w] = top
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_spelling_variants_are_exact(spark, symbols):
    r = random.Random(8)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 9))) for _ in range(25)]
    words = list(stems)
    for _ in range(4):
        for w in r.sample(words, 25):
            i = r.randrange(len(w))
            words.append(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abcÉÿ") + w[i:], w[:i] + r.choice("abcÉÿ") + w[i + 1:]]))
    weights = [5 ** r.randint(0, 3) for _ in words]
    rows = [(None if k == 3 else k, " ".join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in r.choices(words, weights, k=400)) + " z" * 20) for k in range(12)]
    rows += [(50, None), (51, ""), (52, "x" * 4000 + " ") , (0, "aaaaaa aaaaab " * 6), (0, "aaaaaa aaaaab " * 6), (60, ("y" * 3000 + " ") * 5 + ("y" * 3001 + "1") * 25), (70, "chainaa " * 125 + "chainab " * 25 + "chainbb " * 5)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, word string, n string").repartition(3)
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling_variants.variants(spark, frame, symbols=symbols).collect()}
    assert got == variants_of(rows) and any(v[0] for v in got.values()) and any(v[0] and v[1] != v[0] for v in got.values())


def test_spelling_variants_on_edges(spark, docs, empty):  # noqa: F811
    assert spelling_variants.variants(spark, empty).collect() == []
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling_variants.variants(spark, docs).collect()}
    counted = {w: v[2] for w, v in variants_of_counts(pairs(docs)).items()}
    assert {w: v[2] for w, v in got.items()} == counted


def variants_of_counts(rows):
    """As ``variants_of``, without near words: the edge table has too many words to compare all."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: (None, w, k) for w, k in counts.items() if len(w) >= 6 and k >= 5}


# source audit

def audit_of(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, seen, counts = set(), defaultdict(set), Counter()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            seen[lang, w].add(k)
            counts[lang, source, w] += 1
    kept = defaultdict(list)
    for (lang, w), ids in seen.items():
        if len(ids) >= min_docs:
            kept[lang].append(w)
    out = []
    for lang, source in groups:
        words, others = kept[lang], [s for x, s in groups if x == lang]

        def shares(names):
            n = {w: sum(counts[lang, s, w] for s in names) for w in words}
            total = sum(n.values()) + 5 * len(words)
            return {w: 1 + 10**9 * (n[w] + 5) // total for w in words}

        p, q = shares([source]), shares(others)
        pair = [(s, sum(abs(p[w] - x) for w, x in shares([s]).items())) for s in others if s != source]
        over = [(w, p[w] - q[w]) for w in words if counts[lang, source, w] and p[w] > q[w]]
        for part, items in (("pair", pair), ("term", over)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def test_source_audit_is_exact(spark, docs, empty):  # noqa: F811
    r = random.Random(9)
    forms = ["word", "Word,", "WORD", "word-word", "other", "Other.", "(other)", "é é", "a1b", "1", "--", "日本", "rare", "Rare!"]
    rows = [(" ".join(r.choices([*forms, f"w{k % 7}x"], k=r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "S", None])) for k in range(60)]
    rows += [(None, "en", "only"), ("", "xx", "a"), ("12 34", "xx", "b"), ("a" * 3000 + ",word", "en", "s1"), *rows[:3]]
    frame = spark.createDataFrame([(*x, i, "z") for i, x in enumerate(rows)], "text string, lang string, source string, term long, chunk string").repartition(4)
    for min_docs, top in ((2, 3), (5, 50), (1000, 50)):
        got = sorted(tuple(x) for x in source_audit.audit(spark, frame, min_docs=min_docs, top=top).collect())
        assert got == audit_of(rows, min_docs, top)
    assert source_audit.audit(spark, empty).collect() == []
    same = [(x["text"], x["lang"], x["source"]) for x in docs.collect()]
    assert sorted(tuple(x) for x in source_audit.audit(spark, docs, min_docs=2).collect()) == audit_of(same, 2, 50)


def test_source_audit_counts_doubtful_terms_exactly(spark):
    """The bounds from chunk counts leave terms open; the bit map only saves rows."""
    rows = [("Word, word word; x", "en", "s")] * 3 + [("word", "en", "t")] * 2 + [("Word,", "en", "t")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    own = source_audit.group_columns(frame, "text", "lang", "source")
    bounds = {x["term"]: (x["least"], x["most"]) for x in source_audit.term_bounds(source_audit.tokenized(source_audit.chunk_counts(own))).collect()}
    assert bounds == {"word": (5, 12), "x": (3, 3)}
    for min_docs, kept in ((5, {"word"}), (6, {"word"}), (7, set())):
        scratch = common.Scratch(spark, "audit-test")
        assert {x["term"] for x in source_audit.kept_terms(own, scratch, min_docs)[1].collect()} == kept


# fitted classifiers

@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.Toxicity.fit(table(spark, SF01, "documents"), table(spark, SF01, "labels"))


def scores(model, texts):
    import pandas as pd
    return np.concatenate([np.asarray(x) for x in model.probabilities()(iter([pd.Series(texts, dtype=object)]))])


def test_misspelled_insults_are_caught_and_clean_documents_left(spark, toxic_model):
    own = table(spark, SF01, "documents").join(table(spark, SF01, "labels").where("toxic = 0"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(200)
    clean = [x["text"] for x in own.collect()]
    assert (scores(toxic_model, clean) >= 0.7).sum() <= 2
    for tail in ("you are a moron", "you are a moronn", "you are a mor0n", "what a scvm", "you idiiot"):
        assert (scores(toxic_model, [t + " " + tail for t in clean]) >= 0.7).mean() > 0.98, tail
    assert (scores(toxic_model, [t + ' he said "moron" once' for t in clean]) >= 0.7).mean() < 0.05
    assert min(toxic_model.weights[k] for k in range(len(toxicity.FEATURES)) if k != toxicity.FREE) >= 0


def test_toxicity_on_held_out_labels(spark, toxic_model):
    rows = toxic_model.score(table(spark, SF01, "documents")).where("held_out").join(table(spark, SF01, "labels"), "doc_id").where("toxic is not null")
    got = rows.groupBy("toxic").agg(F.sum("predicted").alias("found"), F.count(F.lit(1)).alias("n")).collect()
    found = {x["toxic"]: (x["found"], x["n"]) for x in got}
    assert found[1][0] >= 0.9 * found[1][1] and found[0][0] <= 0.01 * found[0][1]


def test_fitted_toxicity_on_edges(spark, toxic_model, docs, empty):  # noqa: F811
    got = toxic_model.score(docs).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got) and toxic_model.score(empty).collect() == []
    by_id = {x["doc_id"]: x["score"] for x in got}
    assert by_id[4] == by_id[6] < 0.1 and by_id[11] > 0.7  # no text, no words; insults
    labels = table(spark, SF01, "labels")
    name, stage = corpus_pipeline.STAGES[0]
    kept = stage(spark, docs, SF)
    assert name == "toxicity" and kept.columns == docs.columns and stage(spark, empty, SF).collect() == [] and labels.count() > 0
    assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))


def test_copies_are_no_evidence(spark):
    """Words of one toxic document with many copies are not admitted; words in many different ones are."""
    r = random.Random(10)

    def plain(n=30):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(n))

    copy = plain() + " badly " + plain(3)
    texts = [(copy, 1)] * 60 + [(f"{plain(10)} rotten {plain(10)}", 1) for _ in range(60)] + [(plain(), 0) for _ in range(240)]
    docs_, labels = zip(*[((i, t), (i, 1, y)) for i, (t, y) in enumerate(texts)])
    model = toxicity.Toxicity.fit(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "rotten" in model.lexicon and "badly" not in model.lexicon


@pytest.fixture(scope="module")
def quality_model(spark):
    return quality_crf.QualityField.fit(table(spark, SF01, "documents"), table(spark, SF01, "labels"), bound=800)


def test_quality_on_held_out_labels(spark, quality_model):
    rows = quality_crf.quality(table(spark, SF01, "documents"), quality_model).where("held_out").join(table(spark, SF01, "labels"), "doc_id").where("quality is not null")
    right = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97


def test_fitted_quality_on_edges(spark, quality_model, docs, empty):  # noqa: F811
    got = quality_crf.quality(docs, quality_model).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got) and quality_crf.quality(empty, quality_model).collect() == []
    by_id = {x["doc_id"]: x["score"] for x in got}
    assert by_id[4] == by_id[6] == by_id[None] == 0
    for texts in (["", "a b c"], [None, "a b c"], [" \n", "a b c"], [""]):
        score, good = quality_model.quality(texts)
        assert score[0] == 0 and good[0] == 0 and len(score) == len(texts)


def test_long_lines_are_one_line(monkeypatch):
    r = random.Random(11)
    words = ["the", "a", "Dog", "###", "x1", "cat!", "and.", "éa", "the the"]
    long = " ".join(r.choice(words) for _ in range(90_000))
    texts = [f"head line\n{long}\ntail", f"{long} x\n{long}", "z" * 600_000 + "\nend"]
    blocks = list(quality_crf.documents_lines(texts))
    monkeypatch.setattr(hashing, "BLOCK", 1 << 23)
    assert [len(b) for b in blocks] == [3, 2, 2]
    for a, b in zip(blocks, quality_crf.documents_lines(texts)):
        np.testing.assert_allclose(a, b)


# HTML

@pytest.mark.parametrize("page", ["<p", "<xxxx", '<p a="', "<p '", "<div>", "<li><p>", "<!--", "<![CDATA[", "<", "<!", "<script>", "</div>", "<p>word. ", "x<a "])
@pytest.mark.parametrize("end", ["", ">", '">"'])
def test_broken_pages_take_linear_time(page, end):
    text = page * (1_000_000 // len(page)) + end
    t = time.monotonic()
    html_template.main_text(text, {}, frozenset())
    assert time.monotonic() - t < 20


def test_copies_of_a_page_are_no_template(spark):
    story = " ".join(f"Sentence number {k} of the story tells something." for k in "abcdefgh")
    for element in ("article", "div"):
        page = "<div>Home About</div><%s><p>{0}</p></%s><div>Views {1}</div><div>All rights reserved</div>" % (element, element)
        pages = [("https://f.example/1", page.format(story, 1)), ("https://f.example/2", page.format(story, 2)), ("https://f.example/3", page.format("Another text, quite another.", 3))]
        got = html_texts(spark, pages)
        assert all(story in t and "Home" not in t and "reserved" not in t for t in got[:2]) and "Another text, quite another." in got[2]


def test_template_text_of_an_article_stays(spark):
    page = "<nav>Menu</nav><article><h1>Weekly report</h1><p>Results for all regions.</p><p>Week {0} was good.</p></article><div>Imprint</div>"
    assert html_texts(spark, [(f"https://g.example/{i}", page.format(i)) for i in range(6)]) == [f"Weekly report\n\nResults for all regions.\n\nWeek {i} was good." for i in range(6)]
    page = "<article><h2>Introduction</h2><p>First {0} text.</p><h2>Conclusion</h2><p>Last {0} text.</p></article>"
    assert html_texts(spark, [(f"https://h.example/{i}", page.format(i)) for i in range(6)]) == [f"Introduction\n\nFirst {i} text.\n\nConclusion\n\nLast {i} text." for i in range(6)]
    plain = "<div>Home About</div><div><h2>Introduction</h2><p>First {0} text here.</p><h2>Conclusion</h2><p>Last {0} text here.</p></div><div><h3>Follow us</h3><p><a href='/'>Feed</a></p></div>"
    assert html_texts(spark, [(f"https://i.example/{i}", plain.format(i)) for i in range(6)]) == [f"Introduction\n\nFirst {i} text here.\n\nConclusion\n\nLast {i} text here." for i in range(6)]


def test_a_host_of_one_page(spark):
    page = "<div>Home About</div><div><p>The text of the page.</p><p>It goes on for a while</p><p>and it ends here.</p></div><div>All rights reserved</div>"
    assert html_texts(spark, [("https://j.example/", page)]) == ["The text of the page.\n\nIt goes on for a while\n\nand it ends here."]


def test_html_on_edges(spark):
    rows = [(1, "https://k.example/", None, "x", "y"), (1, "https://k.example/", "", "x", "y"), (None, None, "<p>One text.", "x", "y"), (2, "no url", "<p>" + "long words " * 100_000, "x", "y"),
            (3, "https://k.example/", "<p>One text.", "x", "y"), (3, "https://k.example/", "<p>One text.", "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, tokens string")
    got = sorted((str(x["page_id"]), x["text"], x["n_chars"]) for x in html_template.extract(frame).collect())
    long = ("long words " * 100_000).strip()
    assert got == sorted([("1", "", 0), ("1", "", 0), ("None", "One text.", 9), ("2", long, len(long)), ("3", "One text.", 9), ("3", "One text.", 9)])


# secrets

def findings(seed, n=400):
    """Documents with one candidate each and what it is: the label is the generator's, not a rule of the features."""
    r = random.Random(seed)

    def run(alphabet, k):
        return "".join(r.choice(alphabet) for _ in range(k))

    mixed, hexa = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    kinds = [lambda: (f"use gh{run('ops', 1)}_{run(mixed, 36)} for the upload", 1), lambda: (f"the key is {run(mixed, 32)} as of today", 1),
             lambda: (f'token = "{run(mixed, 40)}"', 1), lambda: (f"session_token: {run(hexa, 8)}-{run(hexa, 4)}-{run(hexa, 4)}-{run(hexa, 4)}-{run(hexa, 12)}", 0),
             lambda: (f"call {run('0123456789', 18)} now", 0), lambda: (f"merged in {run(hexa, 40)} by us", 0), lambda: (f'secret = "{run("abc", 1) * 20}"', 0)]
    rows = [r.choice(kinds)() for _ in range(n)]
    return [(k, t, f"src/f{k}.py", y) for k, (t, y) in enumerate(rows)]


def test_forest_learns_labelled_findings_not_the_rule(spark):
    rows = findings(1)
    docs_ = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, source string").repartition(3)
    found = secret_forest.features(secret_forest.candidates(docs_))
    truth = {x[0]: x[3] for x in rows}
    labelled = found.select("doc_id", "position").collect()
    labelled = spark.createDataFrame([(x.doc_id, x.position, truth[x.doc_id]) for x in labelled], "doc_id long, position int, label int")
    got = [x for x in secret_forest.scan(spark, docs_, labelled).collect() if x.held_out]
    hit = sum(x.kept and truth[x.doc_id] for x in got)
    assert hit >= 0.9 * sum(truth[x.doc_id] for x in got) and hit >= 0.9 * sum(x.kept for x in got) and len(got) > 80  # recall and precision
    rule = {(x.doc_id, x.position): x.label for x in found.withColumn("label", secret_forest.rule_label()).collect()}
    differ = [x for x in got if rule[x.doc_id, x.position] is not None and x.kept != bool(rule[x.doc_id, x.position])]
    assert len(differ) > 10 and sum(x.kept == bool(truth[x.doc_id]) for x in differ) >= 0.9 * len(differ)


def test_forest_finds_shapes_without_context(spark):
    """Fitted on what the rules label, it keeps tokens in running text that look like assigned ones, and no prose."""
    r = random.Random(2)
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def run(k):
        return "".join(r.choice(mixed) for _ in range(k))

    texts = [f'token = "{run(40)}"' for _ in range(150)] + [f"a {''.join(r.choice('etaoinsh') for _ in range(20))} word" for _ in range(150)]
    texts += [f"use ghp_{run(36)} today" for _ in range(30)] + [f'example token="{run(40)}"' for _ in range(10)]
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    kept = {x.doc_id: x.kept for x in secret_forest.scan(spark, docs_).collect()}
    assert all(kept[k] for k in range(150)) and not any(kept[k] for k in range(150, 300))
    assert sum(kept[k] for k in range(300, 330)) >= 25 and not any(kept[k] for k in range(330, 340))


def test_secret_scan_on_edges(spark, docs, empty):  # noqa: F811
    got = secret_forest.scan(spark, docs).collect()
    assert [x for x in got if x.doc_id == 14] and secret_forest.scan(spark, empty).collect() == []
    text = [(1, 'token = "0123456789abcdef0123456789abcdef01234567"', None, "x", 2)] * 2
    twice = spark.createDataFrame(text, "doc_id long, text string, source string, position string, score long")
    assert len(secret_forest.scan(spark, twice).collect()) == 2
