"""Portable views that turn the driver's tables into the reference's shapes.

Each view is one SQL statement that runs unchanged in Spark SQL and
DuckDB; base tables are written as ``@name@`` tokens. Spark resolves them
to session temp views over the parquet files, DuckDB to its registered
tables (the oracle SQL inlines the views as CTEs).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    # twelve short completion shapes per (prompt, generation); whole documents (a third of them
    # generations of one prompt) and whole assistant turns as reasoning, with missing, repeated and
    # unclosed tags and answers that are zero, not numeric or null
    "completions": """
select l_orderkey as prompt_id, l_linenumber as gen_id, cast(q as varchar(20)) as answer,
  case v
    when 0 then 'w<end_working_out><SOLUTION>'||q||'</SOLUTION>'
    when 1 then '<start_working_out>w<end_working_out><SOLUTION>'||q||'</SOLUTION>'
    when 2 then '<start_working_out>w'||chr(10)||'<end_working_out>'||chr(10)||'<SOLUTION>'||chr(10)||q||chr(10)||'</SOLUTION>'
    when 3 then '<start_working_out>w<end_working_out><SOLUTION>  '||q||' </SOLUTION>'
    when 4 then '<start_working_out>w<end_working_out><SOLUTION>'||substr(cast(q as varchar(20)),1,1)||' '||substr(cast(q as varchar(20)),2)||'</SOLUTION>'
    when 5 then '<start_working_out>w<end_working_out><SOLUTION>'||cast((q*105-(q*105)%100)/100 as bigint)||'.'||lpad(cast((q*105)%100 as varchar(20)),2,'0')||'</SOLUTION>'
    when 6 then '<start_working_out>w<end_working_out><SOLUTION>'||cast((q*115-(q*115)%100)/100 as bigint)||'.'||lpad(cast((q*115)%100 as varchar(20)),2,'0')||'</SOLUTION>'
    when 7 then '<start_working_out>w<end_working_out><SOLUTION>'||(q*2)||'</SOLUTION>'
    when 8 then '<start_working_out>w<end_working_out><SOLUTION>'||q||'</SOLUTION><SOLUTION>9</SOLUTION>'
    when 9 then '<start_working_out>w<end_working_out><SOLUTION>'||q
    when 10 then 'no formatting here'
    else '<start_working_out>w<end_working_out><SOLUTION>The answer is '||q||' units</SOLUTION>'
  end as completion
from (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as q,
             (l_orderkey*7+l_linenumber)%12 as v from @lineitem@) x
union all
select prompt_id, gen_id, answer,
  case v
    when 0 then '<start_working_out>'||t||'<end_working_out><SOLUTION>'||a||'</SOLUTION>'
    when 1 then chr(10)||'<start_working_out>'||chr(10)||t||chr(10)||chr(10)||'<end_working_out>'||chr(10)||'<SOLUTION>'||chr(10)||a||chr(10)||'</SOLUTION>'||chr(10)
    when 2 then t||'<end_working_out><SOLUTION>'||a||'</SOLUTION>'
    when 3 then '<start_working_out>'||t||'<end_working_out><SOLUTION>'||a||'</SOLUTION><start_working_out>'||t||'<end_working_out><SOLUTION>9</SOLUTION>'
    when 4 then t
    when 5 then '<start_working_out>'||t||'<end_working_out><SOLUTION>The answer is '||a||' units</SOLUTION>'
    when 6 then '<start_working_out>'||t||'<end_working_out><SOLUTION>'||a
    else '<start_working_out>'||t||'<end_working_out><SOLUTION>0</SOLUTION>'
  end as completion
from (
  select prompt_id, gen_id, t, a, v,
    case w when 0 then '0' when 1 then 'about ten' when 2 then cast(null as varchar(20)) else a end as answer
  from (
    select case when doc_id%3 = 0 then cast(0 as bigint) else -doc_id end as prompt_id, cast(doc_id as int) as gen_id,
           text as t, cast(n_chars as varchar(20)) as a, (doc_id*7+1)%8 as v, (doc_id*3+doc_id%11)%7 as w from @documents@
    union all
    select -conv_id as prompt_id, cast(turn as int) as gen_id, text as t, cast(turn as varchar(20)) as a,
           (conv_id+turn)%8 as v, conv_id%7 as w from @conversations@ where role = 'assistant') y) z""",
    # ten answer spellings, half not numeric under the pandas rule
    "sft_raw": """
select doc_id, text as problem,
  case doc_id%10 when 0 then '42' when 1 then ' 7 ' when 2 then '-3.5' when 3 then '1e3' when 4 then 'nan'
    when 5 then '1,000' when 6 then '1/2' when 7 then '1.5d' when 8 then '' else cast(n_chars as varchar(20)) end as expected_answer,
  '<think>'||chr(10)||text||chr(10)||'</think>' as generated_solution
from @documents@""",
    # exercises over all documents: repeated texts (last doc_id wins); every fourth text is a
    # revised wording, so the exact-text ground-truth lookup misses for it
    "exercises": """
select doc_id, 'ex.'||doc_id as exercise_number,
  case when doc_id%4 = 0 then text||' [revised]' else text end as exercise_text,
  source||':'||lang||':'||doc_id as solution_text
from @documents@""",
    # one row per problem and model (two projections of documents, no cross join)
    "responses": """
select doc_id as problem_id, model, text as problem,
  case (doc_id*3+m*2)%7
    when 0 then 'r<end_working_out><SOLUTION>'||n_chars||'</SOLUTION>'
    when 1 then 'r<end_working_out><SOLUTION>'||n_chars
    when 2 then 'plain text only'
    when 3 then 'We see it. Therefore, the value is '||n_chars||'. Done'
    when 4 then 'a &lt; b &amp;amp; c. Thus '||n_chars
    when 5 then '<SOLUTION>'||n_chars||'</SOLUTION>'
    else '<start_working_out>r<end_working_out><SOLUTION>about '||n_chars||'!</SOLUTION>' end as response
from (select doc_id, text, n_chars, 'base' as model, 0 as m from @documents@
      union all
      select doc_id, text, n_chars, 'tuned' as model, 1 as m from @documents@) dm""",
    # four models; the third and fourth answer some problems only
    "responses_4": """
select doc_id as problem_id, model, text as problem,
  case (doc_id*3+m*2)%7
    when 0 then 'r<end_working_out><SOLUTION>'||n_chars||'</SOLUTION>'
    when 1 then 'plain text only'
    when 2 then '<SOLUTION>'||n_chars||'</SOLUTION>'
    when 3 then cast(null as varchar(20))
    else '<start_working_out>r<end_working_out><SOLUTION>about '||n_chars||'!</SOLUTION>' end as response
from (select doc_id, text, n_chars, 'base' as model, 0 as m from @documents@
      union all
      select doc_id, text, n_chars, 'tuned' as model, 1 as m from @documents@
      union all
      select doc_id, text, n_chars, 'third' as model, 2 as m from @documents@ where doc_id%5 <> 0
      union all
      select doc_id, text, n_chars, 'fourth' as model, 3 as m from @documents@ where doc_id%3 = 1) dm""",
    # replies for the four criteria: whole, one criterion missing, one total missing, unparsable
    "verdicts_4": """
select doc_id as problem_id,
  case doc_id%5 when 3 then 'no verdict {' else
  '{"model_a_scores":{"format_adherence":'||a||',"mathematical_correctness":'||b||',"clarity_completeness":'||a||'.5'||
  case when doc_id%5 = 1 then '' else ',"conciseness":'||b end||case when doc_id%5 = 2 then '' else ',"total":'||a end||'},'||
  '"model_b_scores":{"format_adherence":'||b||',"mathematical_correctness":'||a||',"clarity_completeness":'||b||',"conciseness":'||a||',"total":'||b||'.25},'||
  '"model_a_feedback":"fa","winner":"'||case when a > b then 'Model A' when a < b then 'Model B' else 'Tie' end||'"}' end as raw
from (select doc_id, doc_id%10 as a, (doc_id*3+quality)%10 as b from @labels@) l0""",
    # raw judge replies: plain, fenced, think preamble, prose-wrapped, unparsable, no totals
    "verdicts": """
select doc_id as problem_id,
  case doc_id%6
    when 0 then j
    when 1 then 'Here it is:'||chr(10)||'```json'||chr(10)||j||chr(10)||'```'
    when 2 then '<think>compare both</think>'||chr(10)||j
    when 3 then 'Verdict: '||j||' End.'
    when 4 then 'I cannot decide.'
    else '{"model_a_scores":{"correctness":1},"model_b_scores":{"correctness":2},"winner":"Model B","reason":"no total"}' end as raw
from (select doc_id,
  '{"model_a_scores":{"correctness":'||a||',"brevity":'||b||',"clear_explanation":'||b||',"total":'||a||'},'||
  '"model_b_scores":{"correctness":'||b||',"brevity":'||a||',"clear_explanation":'||a||',"total":'||b||'},'||
  '"model_a_feedback":"fa","model_b_feedback":"fb","winner":"'||
  case when a > b then 'Model A' when a < b then 'Model B' else 'Tie' end||'","reason":"r'||doc_id||'"}' as j
  from (select doc_id, doc_id%11 as a, (doc_id*5+quality)%11 as b from @labels@) l0) l1""",
}

_TOKEN = re.compile(r"@(\w+)@")


def base_tables(view: str) -> list[str]:
    return sorted(set(_TOKEN.findall(VIEWS[view])))


def duckdb_view_sql(view: str) -> str:
    return _TOKEN.sub(lambda m: m.group(1), VIEWS[view]).strip()


def cte(*views: str) -> str:
    """``WITH`` clause inlining the named views for the DuckDB oracle."""
    return "with " + ",\n".join(f"{v} as ({duckdb_view_sql(v)})" for v in views) + "\n"


# Partitions to deal every input table to; None leaves the scan's own. The caller's choice
# (the bench sets it: each of its tables is one row group, which would scan as one task).
_OPTIONS: dict[str, int | None] = {"input_partitions": None}


def set_input_partitions(n: int | None) -> None:
    _OPTIONS["input_partitions"] = n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = _OPTIONS["input_partitions"]
    return df.repartition(n) if n else df


def _view_name(sf_dir: str, name: str) -> str:
    h = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:10]
    return f"tessera_{name}_{h}"


def fixture(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The named portable view over the parquet tables in ``sf_dir``."""
    names = {}
    for t in base_tables(view):
        vn = _view_name(sf_dir, t)
        table(spark, sf_dir, t).createOrReplaceTempView(vn)
        names[t] = vn
    return spark.sql(_TOKEN.sub(lambda m: names[m.group(1)], VIEWS[view]))
