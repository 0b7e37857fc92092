"""Edge cases and brute-force comparisons of the training-data operators on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, html_template, jaccard_join, mixing, quality_crf, quality_rules, secret_forest, sentencepiece_codec, suffix_dedup, toxicity
from tessera.llm.common import table
from tessera.llm.queries import ORACLE, PIECE_MODEL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row_id string, key string, sha string, size string, "
          "kept string, copies string, score string, token string, class_id string, n string, words string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def edge_texts():
    base = words_of(120, 1)
    near = base.split(" ")
    near[60] = "changed"
    return [base, base, base.replace(" ", "\n"), " ".join(near), "", None, " \t\n", "one two", "one  two", words_of(30_000, 2), "ÀÉ öü 日本語 😀 " * 30,
            "stupid idiot " * 40, 'he said "you idiot" once ' * 3, base + " tail", 'token = "0123456789abcdef0123456789abcdef01234567" x', "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    texts = edge_texts()
    rows = [(i if i != 5 else None, t, None, None if i % 3 == 0 else f"s{i % 3}", i, *["x"] * 11) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "exact": exact_dedup.exact_dedup,
    "mixing": mixing.mixture,
    "suffix": suffix_dedup.suffix_dedup,
    "jaccard": jaccard_join.jaccard_join,
    "pieces": lambda s, d: sentencepiece_codec.digests(d, PIECE_MODEL),
    "toxicity": lambda s, d: toxicity.Toxicity.fit(d, labels_of(s, [])).score(d),
    "quality": lambda s, d: quality_crf.quality(d, quality_crf.QualityField.fit(d, labels_of(s, []))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document_and_none_for_none(spark, docs, empty, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (i for i, _ in pairs(docs))))
    assert OPERATORS[name](spark, empty).collect() == []


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "toxicity"], ids=lambda s: s[0])
def test_stages_on_edges(spark, docs, empty, stage):
    name, run = stage
    got = run(spark, docs, SF)
    assert run(spark, empty, SF).collect() == []
    if name == "sentencepiece":
        assert got.count() == docs.count()
    else:
        assert got.columns == docs.columns
        assert set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_dedup(spark, docs).collect()
    groups = defaultdict(list)
    for i, t in pairs(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    for x, members in groups.items():
        own = [r for r in got if r["text_sha256"] == hashlib.sha256(x.encode()).hexdigest()]
        assert len(own) == len(members) and sum(r["kept"] for r in own) == 1
        assert {r["keep_id"] for r in own} == {min(members)[3]} and {r["group_size"] for r in own} == {len(members)}
    assert exact_dedup.drop_copies(spark, docs).count() == len(groups)


def test_exact_dedup_chains_and_splits(spark, docs):
    """One key for all texts: the chain keeps them apart. Small buckets: the directory doubles."""
    one = {tuple(r) for r in exact_dedup.exact_dedup(spark, docs, key=lambda x: F.length(x).cast("long") % 2).collect()}
    assert one == {tuple(r) for r in exact_dedup.exact_dedup(spark, docs, capacity=1).collect()}
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    slots = exact_dedup.directory(keys, capacity=100, max_depth=10).collect()
    fill = Counter()
    owner = {r["slot"]: (r["bucket"], r["depth"]) for r in slots}
    for r in keys.collect():
        fill[owner[(r["key"] & (2**64 - 1)) >> 54]] += 1
    assert max(fill.values()) <= 100 and sum(fill.values()) == 2000 and len({d for _, d in owner.values()}) > 1


def test_suffix_dedup_is_exact(spark, tmp_path):
    r = random.Random(3)
    shared = [words_of(60, k) for k in range(4)]
    texts = [None, "", "z" * 900] + [" ".join(r.choice([words_of(r.randint(1, 40), r.random()), r.choice(shared)[r.randint(0, 80):]]) for _ in range(r.randint(1, 6))) for _ in range(60)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(path)
    for hot in (suffix_dedup.HOT, 1):  # all first digits dealt out, too
        old, suffix_dedup.HOT = suffix_dedup.HOT, hot
        try:
            got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(spark, spark.read.parquet(path)).collect()}
        finally:
            suffix_dedup.HOT = old
        data = [(t or "").encode() for t in texts]
        seen = Counter(b[k:k + 200] for b in data for k in range(len(b) - 199))
        for i, b in enumerate(data):
            mark = bytearray(len(b))
            for k in range(len(b) - 199):
                if seen[b[k:k + 200]] > 1:
                    mark[k:k + 200] = b"\1" * 200
            kept = bytes(x for x, m in zip(b, mark) if not m)
            assert got[i] == (len(b), sum(mark), len([s for s in bytes(mark).split(b"\0") if s]), hashlib.sha256(kept).hexdigest())


def shingle_set(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("long_list", [64, 1])
@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_is_exact(spark, tmp_path, n, percent, long_list):
    r = random.Random(4)
    texts = []
    for k in range(12):
        base = words_of(r.choice([3, 12, 40, 90]), k).split(" ")
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = words_of(1, r.random())
            texts.append(" ".join(copy))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate([None, "", *texts])), "doc_id long, text string").repartition(4).write.parquet(path)
    old, jaccard_join.LIST = jaccard_join.LIST, long_list
    try:
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_join(spark, spark.read.parquet(path), words=n, percent=percent).collect()}
    finally:
        jaccard_join.LIST = old
    sets = [shingle_set(t, n) for t in [None, "", *texts]]
    least = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and least[j] < least[i] and 100 * len(a & b) >= percent * len(a | b):
                    least[i], changed = least[j], True
    assert got == {i: (len(s), least[i]) for i, s in enumerate(sets)}


def test_mixing_copies(spark, docs):
    got = mixing.mixture(spark, docs).collect()
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(spark, docs).collect()))
    targets = {r["source_size"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(sum(targets)) and all(t <= 3 * s + 1e-6 for s, t in targets.items())


def test_levenshtein_trie():
    terms = ["idiot", "worthless", "clown", "aaaaa"]
    m = toxicity.Matcher(dict.fromkeys(terms, 3.0))

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(5)
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(r.randint(1, 2)):
                k = r.randrange(len(w) + 1)
                r.choice([lambda: w.insert(k, r.choice("aeiz")), lambda: w.__delitem__(slice(k, k + 1)), lambda: w.__setitem__(slice(k, k + 1), r.choice("aeiz"))])()
            w = "".join(w)
            assert (m[w] is not None) == any(near(w, x) <= 1 for x in terms), w


def test_whole_lexicon_is_matched_misspelled():
    r = random.Random(8)
    lexicon = {"".join(r.choice("abcdefghij") for _ in range(9)): 3.0 + k for k in range(1000)} | {"scum": 2.0}
    m = toxicity.Matcher(lexicon)
    assert all(m["x" + t] and m["x" + t][0] == t for t in lexicon if len(t) == 9)
    assert m["scvm"] == m["scumm"] == ("scum", 2.0, 1)


def test_toxicity_context_and_fit(spark, tmp_path):
    m = toxicity.Matcher({"idiot": 5.0})
    plain, quoted = toxicity.evidence("what an idiot here", m), toxicity.evidence('what "an idiot" here', m)
    assert plain[0] > 0 and quoted[0] == 0 and quoted[2] > 0
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, words_of(30, i) + (" scumbag " + words_of(5, -i) if bad else "")))
        labels.append((i, 1, int(bad)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    scored = toxicity.Toxicity.fit(spark.read.parquet(path), labels_of(spark, labels + [(None, 1, 1), (9999, 1, None)])).score(spark.read.parquet(path)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in scored if r["held_out"]]) > 0.95


def test_logistic_on_separable_data():
    x = np.concatenate([np.zeros((900, 3)), np.full((100, 3), 8.0)])
    w = toxicity.logistic(x, np.repeat([0.0, 1.0], [900, 100]))
    assert np.isfinite(w).all() and x[-1] @ w[:-1] + w[-1] > 2 > -2 > w[-1]


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    sizes, move = [3, 1, 2], r.normal(size=(2, 2))
    chains = quality_crf.Chains([np.zeros((n, 1)) for n in sizes])
    emit = r.normal(size=(sum(sizes), 2))
    got, pair = chains.marginals(emit, move)
    at, pairs_sum = 0, np.zeros((2, 2))
    for n in sizes:
        states = np.array(np.meshgrid(*[[0, 1]] * n, indexing="ij")).reshape(n, -1).T
        weight = np.exp([sum(emit[at + t, s[t]] for t in range(n)) + sum(move[s[t], s[t + 1]] for t in range(n - 1)) for s in states])
        weight /= weight.sum()
        for t in range(n):
            assert got[at + t, 1] == pytest.approx(weight[states[:, t] == 1].sum())
            if t + 1 < n:
                np.add.at(pairs_sum, (states[:, t], states[:, t + 1]), weight)
        at += n
    assert pair == pytest.approx(pairs_sum)


def test_pieces_parity_and_round_trip(docs):
    import sentencepiece
    codec, other = sentencepiece_codec.Codec(PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = [t or "" for _, t in pairs(docs)] + ["  two  spaces ", "a\tb\n\nc", " lead", "▁marker", "tail   "]
    for text, ids in zip(texts, codec.encode(texts)):
        assert list(ids) == other.encode(text)
        if "▁" not in text:
            assert codec.decode([ids]) == [text]


def test_units_that_differ_only_together_are_compared_whole():
    import sentencepiece
    other = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)

    class Reference:  # differs on texts of several words
        def encode(self, text):
            return other.encode(text) + [0] * (" " in text.strip())

    codec = sentencepiece_codec.Codec(PIECE_MODEL)
    assert [same for _, same, _ in codec.verified(["two words", "single"], Reference())] == [False, True]
    assert [back for _, _, back in codec.verified(["two words", "single"], Reference())] == [True, True]
    codec = sentencepiece_codec.Codec(PIECE_MODEL)

    class Lower:  # a normaliser that the reference does not have
        def normalize_str(self, text):
            return text.lower()

    codec.normaliser = Lower()
    assert [(same, back) for _, same, back in codec.verified(["Two", "two"], other)] == [(False, False), (True, True)]


PAGE = ("<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home {0}</a></li></ul></nav>"
        "<div class='ad'>Buy {0}</div><article><h1>Head {0}</h1><p>One &amp; {0}<br>two</p><p>Three  <b>four</b>{0}<div class='comments'><p>Comment {0}</p></div></article>"
        "<aside>Side</aside><footer>&copy; {0}</footer></body></html>")


def test_html_extraction(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(i), "x") for i in range(12)] + [(90, None, None, "x"), (91, "x", "", "x"), (92, "https://b.example/", "<p>No article &lt;x&gt;", "x"), (None, None, PAGE.format(99), "x")]
    got = {r["page_id"]: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(got) == len(rows)
    assert got[3]["text"] == "Head 3\n\nOne & 3 two\n\nThree four3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "No article <x>"
    bare = [(i, f"https://c.example/{i}", f"<html><body><div><p>Same words</p><p>Own words {i} <a href='/'>x{i}</a></p><p><a href='/y'>All links</a></p></div></body></html>", "x") for i in range(12)]
    texts = {r["text"] for r in html_template.extract(spark.createDataFrame(bare, "page_id long, url string, html string, host string")).collect()}
    assert texts == {f"Own words {i} x{i}" for i in range(12)}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_template.extract(none).collect() == []


def html_texts(spark, pages):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html_template.extract(rows).collect(), key=lambda r: r["page_id"])]


def test_html_template_bounds_slots_inside_the_article(spark):
    page = "<html><body><article class='post' id='p{0}'><h1>Head {0}</h1><p>Share this story</p><p>Text {0} <b>of</b> us</p>{1}</article></body></html>"
    texts = html_texts(spark, [(f"https://d.example/{i}", page.format(i, "<p>More</p>" * (i % 3))) for i in range(9)])
    assert texts == [f"Head {i}\n\nText {i} of us" for i in range(9)]


def test_html_roles_tell_order_and_slots():
    def roles(page):
        walk = html_template.Walk(page)
        ids = [html_template.token_id(p, t) for _, p, t, *_ in walk.items]
        return dict(zip((t for _, _, t, *_ in walk.items), html_template.roles(walk, {t: ids.count(t) for t in ids})))

    page, other = roles("<ul><li>x</li><li>y</li></ul>a<hr>b"), roles("<ul><li>z</li><li>y</li></ul>b<hr>a")
    assert page["open:ul."] == other["open:ul."] and page["open:li."] != page["close:li"]
    assert page["text:a"] != other["text:a"] and page["text:b"] != other["text:b"]  # the order of their class differs
    assert roles("<p>a</p><p>b</p>")["text:b"] != roles("<p>a</p>b<p></p>").get("text:b")  # the slot around it differs


def test_html_class_names_never_drop_the_article():
    def text(body):
        return html_template.main_text(f"<html><body>{body}</body></html>", {}, frozenset())

    long = "long words of the page " * 8
    long = long.strip()
    for name in ("site-main has-sidebar", "content no-sidebar", "post social", "layout with-header"):
        assert text(f"<div class='{name}'><article><p>{long}</p></article></div>") == long
        assert text(f"<article class='{name}'><p>{long}</p></article>") == text(f"<main class='{name}'><p>{long}</p></main>") == long
        assert text(f"<div class='{name}'><p>{long}</p></div><p>end</p>") == long + "\n\nend"
    comment = "<article class='comment-body'><p>I disagree</p></article>"
    assert text(f"<div class='entry-content'><p>{long}</p></div>{comment}") == text(f"<article><p>{long}</p></article><div class='comments'>{comment}</div>") == long
    assert long in text(f"<div class='entry'><p>{long}</p></div><article><p>Box</p></article>")
    assert text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><xmp><b>&amp;</xmp></article>") == "So x=1\n\n<b>&amp;"
    assert text(comment) == "I disagree"


@pytest.mark.parametrize("size", [2, 3, 12])
def test_html_template_by_share_of_pages_with_tokens(spark, size):
    page = "<div><div>Home About Contact</div><p>Own words {0}</p><div>All rights reserved</div></div>"
    pages = [("https://e.example/", page.format(i)) for i in range(size)] + [("https://e.example/", None), ("https://e.example/", "")]
    if size > 2:
        pages.append(("https://e.example/", "<p>odd"))
    assert html_texts(spark, pages) == [f"Own words {i}" for i in range(size)] + ["", ""] + ["odd"] * (size > 2)


def test_secret_candidates_of_any_length_and_characters(spark):
    letters = "qwertzuiopasdfghjklyxcvb"
    texts = ['password = "hunter2!" # ok', "db_password: s3c.r3t@x:9$y", f"see {letters} here", 'passphrase = "correct horse battery"', "Server=x;Password=a;b1;Uid=me",
             '{"api_key":"k.1"}', "secret='it\\'s' end", "Authorization: Bearer ab.cd.ef", "token=0123456789abcdef0123", 'password = ""', "no value: here", "x\ufdd0 pwd=a(b)c, y"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = sorted((r["doc_id"], r["position"], r["value"]) for r in secret_forest.candidates(rows).collect())
    assert found == [(0, 2, "hunter2!"), (1, 1, "s3c.r3t@x:9$y"), (2, 1, letters), (3, 2, "correct horse battery"), (4, 0, "a;b1"), (5, 0, "k.1"), (6, 0, "it\\'s"),
                     (7, 2, "ab.cd.ef"), (8, 0, "0123456789abcdef0123"), (11, 1, "a(b)c")]
    long = spark.createDataFrame([(0, "token=" + "a;b.\\" * 50_000 + " \"" + "password='" * 20_000, None)], "doc_id long, text string, source string")
    assert secret_forest.candidates(long).count() > 0


def test_secret_placeholders_are_whole_words(spark):
    hexa = "0123456789abcdef0123456789abcdef01234567"
    texts = [f'the latest token="{hexa}"', f'the test token="{hexa}"', f'my_test token="{hexa}"', 'password = "your-password"', "pwd = xxxxxxxx", 'password = "hunter2!"']
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = secret_forest.features(secret_forest.candidates(rows)).withColumn("label", secret_forest.rule_label()).collect()
    assert [r["label"] for r in sorted(got, key=lambda r: r["doc_id"])] == [1, 0, 0, 0, 0, 1]


def test_secret_scan(spark, tmp_path, empty):
    r = random.Random(6)
    rows = []
    for i in range(200):
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'see token = "{hexa}" here' if i % 2 else f"call {r.randrange(10**15, 10**16)} now", "src/a.py" if i % 3 else None))
    rows.append((None, None, None))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    got = secret_forest.scan(spark, spark.read.parquet(path)).collect()
    assert len(got) == 200 and all(x["kept"] == bool(x["doc_id"] % 2) for x in got)
    assert secret_forest.scan(spark, empty).collect() == []


def test_rules_match_sql(spark, docs):
    import duckdb
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    con.register("documents", frame)
    got = {str(r["doc_id"]): r for r in quality_rules.quality_rules(docs).collect()}
    rel = con.sql(ORACLE["op3_quality_rules"])
    for row in rel.fetchall():
        own = dict(zip(rel.columns, row))
        key = "None" if own["doc_id"] is None or own["doc_id"] != own["doc_id"] else str(int(own["doc_id"]))
        assert {k: got[key][k] for k in own if k != "doc_id"} == {k: v for k, v in own.items() if k != "doc_id"}


def test_pipeline_runs_and_keeps_clean_documents(spark):
    before = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").where("toxic = 0")
    kept = corpus_pipeline.drop_toxic(spark, before, SF)
    assert before.join(labels, "doc_id").count() - kept.join(labels, "doc_id").count() <= 2
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "source", "ids"]
    assert len([q for q in QUERIES if q.startswith("op")]) == 13
