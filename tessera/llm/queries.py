"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (exact_dedup, html_template, jaccard_join, license_rules, mixing, quality_crf, quality_rules, secret_forest, sentencepiece_codec,
                         source_audit, spelling_variants, suffix_dedup, toxicity)
from tessera.llm.common import table

#: Directory of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.Toxicity.fit(docs, table(spark, d, "labels"))
    return model.score(docs).drop("row_id")


@query
def op2_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    return quality_crf.quality(docs, quality_crf.QualityField.fit(docs, table(spark, d, "labels")))


@query
def op3_quality_rules(spark, d):
    return quality_rules.quality_rules(table(spark, d, "documents"))


@query
def op4_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(spark, table(spark, d, "documents"))


@query
def op5_sentencepiece(spark, d):
    return sentencepiece_codec.digests(table(spark, d, "documents"), PIECE_MODEL)


@query
def op6_mixing(spark, d):
    return mixing.mixture(spark, table(spark, d, "documents"))


@query
def op7_html_extraction(spark, d):
    return html_template.extract(table(spark, d, "pages"))


@query
def op8_suffix_dedup(spark, d):
    return suffix_dedup.suffix_dedup(spark, table(spark, d, "documents"))


@query
def op9_jaccard_join(spark, d):
    return jaccard_join.jaccard_join(spark, table(spark, d, "documents"), words=4, percent=85)


@query
def op10_secret_scan(spark, d):
    return secret_forest.scan(spark, table(spark, d, "documents"))


@query
def op11_license_scan(spark, d):
    found = license_rules.scan(table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op12_spelling_variants(spark, d):
    return spelling_variants.variants(spark, table(spark, d, "documents"))


@query
def op13_source_audit(spark, d):
    return source_audit.audit(spark, table(spark, d, "documents"))


_WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))


def _rules_sql() -> str:
    terms = []
    for r in quality_rules.RULES:
        base = "1" if r.denominator == "one" else r.denominator
        if r.low is not None:
            terms.append(f"100 * {r.numerator} >= {r.low} * {base}")
        if r.high is not None:
            terms.append(f"100 * {r.numerator} <= {r.high} * {base}")
    return " and ".join(terms)


ORACLE["op3_quality_rules"] = rf"""
with base as (
  select doc_id, row_number() over () as r, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
windows as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x from (select r, w, unnest(generate_series(1, len(w) - 2)) as i from base) u),
covered as (
  select r, count(distinct p) as n from (
    select r, unnest([i, i + 1, i + 2]) as p from (select r, i, count(*) over (partition by r, x) as k from windows) c where k > 1) p group by r),
m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
    len(list_filter(w, lambda x: lower(x) in ({_STOP})))::bigint as n_stop_words, len(regexp_extract_all(t, '!'))::bigint as n_bangs
  from base left join covered using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and {_rules_sql()} as kept from b"""

ORACLE["op4_exact_dedup"] = r"""
with n as (
  select doc_id, row_number() over () as r, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as x from documents),
k as (
  select *, count(*) over (partition by x) as group_size,
    first_value(r) over (partition by x order by length(t) desc, doc_id nulls last, r) as keep_row,
    first_value(doc_id) over (partition by x order by length(t) desc, doc_id nulls last, r) as keep_id from n)
select doc_id, keep_id, group_size, r = keep_row as kept, sha256(x) as text_sha256 from k"""


def _mixing_sql(table_name: str) -> str:
    return rf"""
entries as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), coalesce(md5(text), ''))), 1, 8))::ubigint::double / 4294967296.0 as coin
  from {table_name}),
sources as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last)) - 1) % 3 + 1 as weight from entries group by source),
ordered as (
  select *, row_number() over w as k, sum(3 * source_size) over w as capped, sum(weight) over w as lighter from sources
  window w as (order by 3.0 * source_size / weight, weight, source nulls last rows unbounded preceding)),
levels as (
  select k, (t.total - (capped - 3 * source_size)) / cast(t.weights - (lighter - weight) as double) as level, 3 * source_size as cap, weight
  from ordered, (select sum(source_size)::double as total, sum(weight)::bigint as weights from sources) t),
level as (select level from levels where level * weight <= cap order by k limit 1),
targets as (
  select source, source_size, case when (select level from level) is null then 3.0 * source_size
    else least((3 * source_size)::double, (select level from level) * weight) end as target from sources),
mixed as (
  select e.doc_id, e.size, t.source_size, t.target, e.coin, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate
  from entries e join targets t on e.source is not distinct from t.source)"""


ORACLE["op6_mixing"] = f"""
with {_mixing_sql('documents')}
select doc_id, size, source_size, target,
  (size * (floor(rate)::bigint + case when coin < rate - floor(rate) then 1 else 0 end))::bigint as taken from mixed"""

ORACLE["op13_source_audit"] = rf"""
with d as (
  select row_number() over () as r, translate(coalesce(text, ''), '{source_audit.UPPER}', '{source_audit.LOWER}') as t, coalesce(lang, '') as lang,
    coalesce(source, '') as source from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '{source_audit.TERM}')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= {source_audit.MIN_DOCS}),
groups as (select distinct lang, source from d),
n as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term),
v as (select lang, count(*)::hugeint as v from kept group by lang),
grid as (
  select g.lang, g.source, k.term, coalesce(n.n, 0)::hugeint as n, sum(coalesce(n.n, 0)) over (partition by g.lang, g.source)::hugeint as total, v.v
  from groups g join kept k using (lang) join v using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
p as (select lang, source, term, n, (1 + ({source_audit.SCALE}::hugeint * (n + {source_audit.ADD})) // (total + {source_audit.ADD} * v))::bigint as p from grid),
sums as (select lang, term, sum(n)::hugeint as n from grid group by lang, term),
q as (
  select lang, term, (1 + ({source_audit.SCALE}::hugeint * (n + {source_audit.ADD})) // (sum(n) over (partition by lang)::hugeint + {source_audit.ADD} * v))::bigint as q
  from sums join v using (lang)),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join (
    select a.lang, a.source, b.source as other, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term group by all) x
    on x.lang = a.lang and x.source = a.source and x.other = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, p - q as value from p join q using (lang, term) where p.n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms) u)
select * from ranked where part = 'pair' or rank <= {source_audit.TOP}"""

ORACLE["op12_spelling_variants"] = rf"""
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
lowered as (select id, translate(run, '{spelling_variants.UPPER}', '{spelling_variants.LOWER}') as run, count(*) as k from runs group by 1, 2),
bytes as (
  select *, list_transform(range(length(hex(id || ':' || run)) // 2), lambda i: ('0x' || substr(hex(id || ':' || run), 2 * i + 1, 2))::bigint) as b
  from lowered where length(run) >= {spelling_variants.MIN_LETTERS}),
hashed as (
  select run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, crc_table),
words as (
  select case when h % {spelling_variants.DAMAGED} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(k)::bigint as n
  from hashed group by 1),
vocab as materialized (select word, n from words where length(word) >= {spelling_variants.MIN_LETTERS} and n >= {spelling_variants.MIN_COUNT}),
cut as materialized (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from vocab) u),
near as (
  select a.word, b.word as other, b.n as m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, v.word, v.n from cut c join vocab v on c.rest = v.word
  union select v.word, c.word, c.n from cut c join vocab v on c.rest = v.word),
best as (select word, count(*) as n_near, first(other order by m desc, other) as top, max(m) as m from near group by word),
formed as materialized (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when m >= {spelling_variants.RATIO} * v.n then top end as form,
    case when m >= {spelling_variants.RATIO} * v.n then m end as form_n from vocab v left join best using (word)),
chain as (
  select word, word as root, form as next from formed
  union all select chain.word, formed.word, formed.form from chain join formed on chain.next = formed.word)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.next is null"""


def _license_sql() -> str:
    def text(x):
        return "'" + x.replace("'", "''") + "'"

    rules = ", ".join(f"({k}, {text(r.label)}, {text(license_rules.keyword_form(r.keyword))}, {text(r.pattern)}, {r.priority}, {r.strength}::double, {r.base})"
                      for k, r in enumerate(license_rules.RULES))
    reach = " or ".join(f"(priority >= {k} and coalesce(max(case when priority = {k} then start + length end) over w >= start + length, false))"
                        for k in range(license_rules.LEVELS))
    return rf"""
with rules(rule, label, keyword, pattern, priority, strength, base) as (values {rules}),
folded as (
  select doc_id, row_number() over () as r,
    trim(regexp_replace(translate(coalesce(text, ''), '{license_rules.UPPER}', '{license_rules.LOWER}'), '{license_rules.SEPARATORS}', '  ', 'g'), ' ') as t from documents),
docs as materialized (select doc_id, r, case when t = '' then '' else ' ' || t || ' ' end as t from folded),
hits as (
  select r, rules.*, string_split_regex(t, pattern) as parts, regexp_extract_all(t, pattern) as found from docs join rules on contains(t, keyword)
  where regexp_matches(t, pattern)),
counted as (
  select r, rule, label, priority, strength, base, i, (length(parts[i]) - length(replace(parts[i], ' ', ''))) // 2 as gap,
    (length(found[i]) - length(replace(found[i], ' ', ''))) // 2 as length
  from (select *, unnest(range(1, len(found) + 1)) as i from hits) u),
places as (select *, sum(gap + length) over (partition by r, rule order by i) - length as start from counted),
kept as (
  select *, not ({reach}) as kept from places
  window w as (partition by r order by start, start + length desc, rule rows between unbounded preceding and 1 preceding)),
found as (
  select r, count_if(base) as n_base, min(case when base then start end) as first_word, max(case when base then start end) as last_word,
    string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) filter (base or kept) as labels,
    max(strength) filter (base or kept) as score from kept group by r)
select doc_id, ((length(t) - length(replace(t, ' ', ''))) // 2)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from docs left join found using (r)"""


ORACLE["op11_license_scan"] = _license_sql()
