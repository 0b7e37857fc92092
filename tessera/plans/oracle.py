"""DuckDB oracle SQL for the registered queries (independent formulations).

Views from :mod:`tessera.plans.fixtures` are inlined as CTEs; rules are
re-spelled with DuckDB/RE2 functions in :mod:`tessera.plans.sqlexpr`.
"""

from __future__ import annotations

from tessera.functions import html as H
from tessera.functions.prompts import JUDGE_PROMPT_3, RUBRIC_WEIGHTS
from tessera.functions.tags import DEFAULT_TAGS as TG
from tessera.operators import compare as C
from tessera.operators.judge import CRITERIA
from tessera.plans import catalog as K
from tessera.plans.fixtures import cte, duckdb_view_sql
from tessera.sources import report as T
from tessera.plans.sqlexpr import (between, contains, count_occ, is_number, normalize, py_float, q,
                                   residue, strip, sft_assistant, sft_text, sys_user_prompt, tokens)

RS, RE, SS, SE, EOS = TG.reasoning_start, TG.reasoning_end, TG.solution_start, TG.solution_end, TG.eos
SYS = TG.system_prompt
ORACLE: dict[str, str] = {}


def D(x) -> str:
    return f"cast({x} as double)"


def DEC(x) -> str:
    return f"cast({x} as decimal(24,9))"


def Q(x: str) -> str:
    return "\\Q" + x + "\\E"


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


# ---- chat rendering and messages --------------------------------------------------
sql("chat_render", f"""
select conv_id,
  (case when arg_min(role, turn) = 'system' then arg_min(text, turn) || {q(EOS)} else {q(SYS + EOS)} end)
  || coalesce(string_agg(case role when 'user' then text when 'assistant' then text || {q(EOS)} else '' end,
                         '' order by turn), '') as text
from conversations group by conv_id""")

sql("chat_render_genprompt", f"select item_id, {sys_user_prompt('text')} as prompt_text from benchmark")

sql("message_prefix", cte("sft_raw") + f"select doc_id, {sys_user_prompt('problem')} as text from sft_raw")

sql("sft_messages", cte("sft_raw") + f"""
select doc_id, cast(3 as integer) as n_messages, problem as user_content,
  {sft_assistant('expected_answer', 'generated_solution')} as assistant_content from sft_raw""")

sql("proof_messages", cte("exercises") + f"""
select doc_id, {q(SYS + EOS)} || exercise_text || {q(RS)} || solution_text || {q(RE + SS + 'Proven.' + SE + EOS)} as text
from exercises""")

sql("rl_messages", """
select item_id, cast(2 as integer) as n_messages, 'system' as first_role, text as user_content,
  cast(item_id as varchar) as answer from benchmark""")

sql("numeric_filter", cte("sft_raw") + f"select doc_id, expected_answer from sft_raw where {is_number('expected_answer')}")

_SFT_T = cte("sft_raw") + f""", t as (
  select doc_id, {sft_text('problem', 'expected_answer', 'generated_solution')} as text
  from sft_raw where {is_number('expected_answer')}),
n as (select doc_id, cast({tokens('text')} as integer) as N from t)
"""
sql("length_filter", _SFT_T + f"select doc_id, N from n where N <= {int(K.MAX_SEQ * K.TRUNCATE_RATIO)}")

sql("length_stats", cte("exercises") + f""", t as (
  select {q(SYS + EOS)} || exercise_text || {q(RS)} || solution_text || {q(RE + SS + 'Proven.' + SE + EOS)} as text
  from exercises),
n as (select cast({tokens('text')} as integer) as N from t)
select min(N) as min_len, max(N) as max_len, avg(N) as mean_len, cast(median(N) as double) as median_len from n""")

_RL_T = f"""with t as (select item_id, cast({tokens(sys_user_prompt('text'))} as integer) as prompt_length from benchmark),
thr as (select cast(trunc(quantile_cont(prompt_length, {K.PERCENTILE / 100.0})) as integer) as m from t)
"""
sql("length_percentile_filter", _RL_T + "select item_id, prompt_length from t where prompt_length <= (select m from thr)")

sql("sequence_budget", _RL_T + f"""
select m as max_prompt_length, {K.MAX_SEQ} - m as max_completion_length, {K.MAX_SEQ} as max_seq_length from thr""")

sql("retention_counts", cte("sft_raw") + f"""
select count(*) as original, cast(count_if({is_number('expected_answer')}) as bigint) as kept,
  count(*) - cast(count_if({is_number('expected_answer')}) as bigint) as removed from sft_raw""")

_EX_T = cte("exercises") + f""", t as (
  select doc_id, exercise_number, cast(length(exercise_text) + length(solution_text) as integer) as approx_length
  from exercises),
test as (select doc_id from t order by approx_length, doc_id limit {K.SHORTEST_N}),
train as (select * from t where doc_id not in (select doc_id from test))
"""
_b, _g, _e = K.PLAN["batch_size"], K.PLAN["grad_accum"], K.PLAN["epochs"]
sql("training_plan", _EX_T + f"""
select count(*) as examples, count(*) // {_b * _g} as steps_per_epoch, (count(*) // {_b * _g}) * {_e} as total_steps,
  (count(*) // {_b * _g}) * {_e} * {D(0.5)} / {D(60.0)} as minutes_lo,
  (count(*) // {_b * _g}) * {_e} * {D(1.0)} / {D(60.0)} as minutes_hi from train""")

sql("shortest_n", _EX_T + f"select doc_id, exercise_number, approx_length from t order by approx_length, doc_id limit {K.SHORTEST_N}")

sql("shortest_n_remainder", _EX_T + "select doc_id, approx_length from train")

_SPLIT_T = f"""with t as (
  select doc_id, n_chars, row_number() over (order by md5('{K.SPLIT_SEED}:' || doc_id), doc_id) as r,
         count(*) over () as n from documents),
l as (select doc_id, n_chars, case when r <= cast(floor(n * {D(K.SPLIT_RATIO)}) as bigint) then 'train' else 'test' end as split from t)
"""
sql("exact_split_sizes", _SPLIT_T + "select split, count(*) as rows, min(n_chars) as min_len, max(n_chars) as max_len from l group by split")
sql("exact_split_members", _SPLIT_T + "select doc_id, split from l")


# ---- rewards -----------------------------------------------------------------------

_R1 = f"(?s){Q(RS)}.*?{Q(RE + SS)}.*?{Q(SE)}"
_R7 = f"(?ms){Q(RE)}.*?{Q(SS)}(.+?){Q(SE)}\\s*(?:{Q(EOS)})?\\s*$"
_SS_REST = f"substr(completion, instr(completion, {q(SS)}) + {len(SS)})"
_NB_NUM = (f"(case when instr(completion, {q(SS)}) > 0 and regexp_matches({_SS_REST}, '-?[0-9.,]') "
           f"then regexp_extract({_SS_REST}, '-?[0-9.,]+') end)")

_RW = cte("completions") + f""", s as (
  select prompt_id, gen_id, answer, completion, {between('completion', SS, SE)} as sol,
         case when regexp_matches(completion, '{_R7}') then regexp_extract(completion, '{_R7}', 1) end as body,
         {_NB_NUM} as nbnum
  from completions),
v as (
  select *, {py_float('sol')} as x, {py_float('answer')} as e,
         case when regexp_matches(sol, '-?[0-9]') then regexp_extract(sol, '-?[0-9]+[.]?[0-9]*') end as num,
         {py_float('body')} as gx, {py_float("replace(nbnum, ',', '')")} as nx
  from s),
r as (
  select prompt_id, gen_id, answer, completion, sol,
    case when regexp_matches(completion, '{_R1}') then {D(3.0)} else {D(0.0)} end as reward_format_exact,
    (case when {count_occ('completion', RE)} = 1 then {D(0.5)} else {D(-1.0)} end
     + case when {count_occ('completion', SS)} = 1 then {D(0.5)} else {D(-1.0)} end
     + case when {count_occ('completion', SE)} = 1 then {D(0.5)} else {D(-1.0)} end) as reward_format_approx,
    case when sol is null then 'NO_MATCH'
         when answer is null then null
         when sol = answer then 'EXACT'
         when replace(sol, ' ', '') = replace(answer, ' ', '') then 'WHITESPACE'
         when x is null or e is null then 'NON_NUMERIC'
         when e = 0 then case when x = 0 then 'EXACT_ZERO' else 'WRONG' end
         when x / e >= 0.9 and x / e <= 1.1 then 'CLOSE'
         when x / e >= 0.8 and x / e <= 1.2 then 'REASONABLE'
         else 'WRONG' end as verdict,
    case when sol is null or num is null or e is null then {D(-1.5)}
         when e = 0 then case when {D('num')} = 0 then {D(4.0)} else {D(-2.0)} end
         when abs({D('num')} - e) < 1e-6 then {D(4.0)}
         when {D('num')} / e >= 0.9 and {D('num')} / e <= 1.1 then {D(2.5)}
         when {D('num')} / e >= 0.8 and {D('num')} / e <= 1.2 then {D(1.5)}
         else {D(-2.0)} end as reward_numbers,
    case when body is not null then {D(3.0)} else {D(0.0)} end as reward_format_exact_nb,
    case when body is null then {D(-2.0)}
         when answer is null then null
         when body = answer then {D(5.0)}
         when {strip('body')} = {strip('answer')} then {D(3.5)}
         when gx is null or e is null or e = 0 then {D(-4.5)}
         when gx / e >= 0.9 and gx / e <= 1.1 then {D(2.0)}
         when gx / e >= 0.8 and gx / e <= 1.2 then {D(1.5)}
         else {D(-2.5)} end as reward_answer_nb,
    case when nbnum is null then {D(-2.5)}
         when nx is null or e is null then {D(0.0)}
         when nx = e then {D(3.5)} else {D(-1.5)} end as reward_numbers_nb
  from v),
rr as (
  select *, {D("case verdict when 'NO_MATCH' then -2.0 when 'EXACT' then 5.0 when 'WHITESPACE' then 3.5 "
               "when 'EXACT_ZERO' then 5.0 when 'CLOSE' then 2.0 when 'REASONABLE' then 1.5 "
               "when 'WRONG' then -2.5 when 'NON_NUMERIC' then -2.5 end")} as reward_answer
  from r),
tot as (
  select *, reward_format_exact + reward_format_approx + reward_answer + reward_numbers as total from rr)
"""

for _name, _col in (("reward_exact", "reward_format_exact"), ("reward_approx", "reward_format_approx"),
                    ("reward_answer", "reward_answer"), ("reward_numbers", "reward_numbers"),
                    ("reward_exact_nb", "reward_format_exact_nb"), ("reward_answer_nb", "reward_answer_nb"),
                    ("reward_numbers_nb", "reward_numbers_nb")):
    sql(_name, _RW + f"select prompt_id, gen_id, {_col} as reward from tot")

sql("reward_verdicts", _RW + "select verdict, count(*) as n from tot group by verdict")

sql("reward_total", _RW + """
select prompt_id, gen_id, reward_format_exact, reward_format_approx, reward_answer, reward_numbers, total from tot""")

sql("reward_group_stats", _RW + f"""
select prompt_id, count(total) as n, count(*) - count(total) as n_null, avg(total) as reward_mean, {DEC('stddev_pop(total)')} as reward_std,
  min(total) as reward_min, max(total) as reward_max from tot group by prompt_id""")

sql("group_advantage", _RW + f""", g as (
  select prompt_id, avg(total) as m, stddev_pop(total) as sd from tot group by prompt_id)
select t.prompt_id, t.gen_id, t.total,
  {DEC("case when t.total is null then null when coalesce(g.sd, 0) = 0 then 0.0 else (t.total - g.m) / g.sd end")} as advantage
from tot t left join g on t.prompt_id = g.prompt_id""")

sql("debug_sample", _RW + f"""
select prompt_id, gen_id, verdict, sol as extracted, answer as expected,
  substr(completion, 1, 200) || '...' as preview from tot
where cast(('0x' || substr(md5('0:' || prompt_id || ':' || gen_id), 1, 8)) as bigint) % {K.SAMPLE_EVERY} = 0""")


# ---- evaluation ------------------------------------------------------------------

_EV = _RW + f""", ev as (
  select prompt_id, gen_id, answer, total,
    coalesce({contains('completion', RS)} and {contains('completion', RE)} and {contains('completion', SS)}
             and {contains('completion', SE)}, false) as format_correct,
    {between('completion', RS, RE)} as rsn, sol
  from tot),
ev2 as (
  select prompt_id, gen_id, answer, total, format_correct,
    coalesce(length(sol) > 0 and (
        coalesce({normalize('sol')} = {normalize('answer')} or instr({normalize('sol')}, {normalize('answer')}) > 0, false)
        or coalesce(abs({py_float(residue('sol'))} - {py_float(residue('answer'))}) < 0.001, false)), false) as answer_correct,
    coalesce(length(rsn) > 0, false) as has_reasoning,
    cast(coalesce(length(rsn), 0) as integer) as reasoning_length
  from ev)
"""
sql("eval_rows", _EV + "select prompt_id, gen_id, format_correct, answer_correct, has_reasoning, reasoning_length from ev2")

_METRICS = f"""
  {D(100.0)} * count_if(format_correct) / count(*) as format_accuracy,
  {D(100.0)} * count_if(answer_correct) / count(*) as answer_accuracy,
  {D(100.0)} * count_if(has_reasoning) / count(*) as reasoning_present,
  {D('sum(reasoning_length)')} / count(*) as avg_reasoning_length,
  coalesce(sum(total), {D(0.0)}) / count(*) as avg_total_reward,
  count(*) as num_samples"""
sql("eval_metrics", _EV + f"select {_METRICS} from ev2")
sql("eval_metrics_by_group", _EV + f"select answer, {_METRICS} from ev2 group by answer")


# ---- comparison -----------------------------------------------------------------

_FC = cte("responses") + f""", fc as (
  select problem_id, model, problem, response,
    {contains('response', RE)} as has_reasoning_end, {contains('response', SS)} as has_solution_start,
    {contains('response', SE)} as has_solution_end,
    {contains('response', RE)} and {contains('response', SS)} and {contains('response', SE)} as format_ok
  from responses),
p as (
  select b.problem_id, b.problem, b.response as base_response, t.response as sft_response,
         b.format_ok as base_ok, t.format_ok as sft_ok
  from fc b join fc t on b.problem_id = t.problem_id and b.model = 'base' and t.model = 'tuned')
"""
sql("format_check", _FC + """
select problem_id, model, has_reasoning_end, has_solution_start, has_solution_end, format_ok from fc""")

sql("pair_outcome", _FC + """
select problem_id, base_ok, sft_ok,
  case when sft_ok and not base_ok then 'tuned_only' when base_ok and sft_ok then 'both'
       when not base_ok and not sft_ok then 'neither' else 'base_only' end as outcome from p""")

sql("pair_summary", _FC + f"""
select cast(count_if(base_ok) as bigint) as base_model_correct, cast(count_if(sft_ok) as bigint) as sft_model_correct, count(*) as num_problems,
  {D('cast(count_if(base_ok) as bigint)')} / count(*) as base_model_accuracy, {D('cast(count_if(sft_ok) as bigint)')} / count(*) as sft_model_accuracy,
  cast(count_if(sft_ok) as bigint) - cast(count_if(base_ok) as bigint) as improvement,
  case when cast(count_if(sft_ok) as bigint) > cast(count_if(base_ok) as bigint) then 'improved'
       when cast(count_if(sft_ok) as bigint) = cast(count_if(base_ok) as bigint) then 'equal' else 'decreased' end as finding
from p""")

sql("single_summary", _FC + """
select model, cast(count_if(format_ok) as bigint) as correct_format, avg(cast(format_ok as integer)) as accuracy,
  count(*) as num_problems from fc group by model""")


# ---- judge --------------------------------------------------------------------------

_GT = _FC.replace("with ", cte("exercises").rstrip("\n") + ",\n", 1) + """, lk as (
  select exercise_text, arg_max(solution_text, doc_id) as solution_text from exercises group by exercise_text),
g as (
  select p.problem_id, p.problem, p.base_response, p.sft_response,
         coalesce(lk.solution_text, 'Ground truth not found') as ground_truth
  from p left join lk on p.problem = lk.exercise_text)
"""
sql("ground_truth_lookup", _GT + "select problem_id, ground_truth from g")


def _prompt_sql() -> str:
    t = JUDGE_PROMPT_3
    for ph, c in (("<<problem>>", "problem"), ("<<ground_truth>>", "ground_truth"),
                  ("<<base_response>>", "base_response"), ("<<sft_response>>", "sft_response")):
        pre, t = t.split(ph, 1)
        yield q(pre)
        yield c
    yield q(t)


sql("judge_prompt", _GT + f"select problem_id, {' || '.join(_prompt_sql())} as judge_prompt from g")

_T0 = strip("raw")
def _scores(side: str, letter: str, criteria) -> str:
    got = lambda c: D(f"json_extract(t3, '$.model_{side}_scores.{c}')")
    return ",\n  ".join([f"{got(c)} as {letter}_{c}" for c in criteria] + [f"coalesce({got('total')}, {D(0.0)}) as {letter}_total"])


def vp_body(view: str, criteria) -> str:
    return f"""verdicts as ({duckdb_view_sql(view)}),
v0 as (select problem_id, {_T0} as t0 from verdicts),
v1 as (select problem_id,
  case when instr(t0, '```json') > 0 then split_part(substr(t0, instr(t0, '```json') + 7), '```', 1)
       when instr(t0, '```') > 0 then split_part(substr(t0, instr(t0, '```') + 3), '```', 1)
       else t0 end as t1 from v0),
v2 as (select problem_id, t1,
  case when instr(t1, '<think>') > 0 and instr(t1, '</think>') > 0
       then {strip("string_split(t1, '</think>')[-1]")} else t1 end as t2 from v1),
v3 as (select problem_id, t1, t2, instr(t2, '{{') as a, instr(reverse(t2), '}}') as rb from v2),
v4 as (select problem_id, t1, t2,
  case when a > 0 and rb > 0 and length(t2) - rb + 1 >= a then substr(t2, a, length(t2) - rb + 1 - a + 1)
       when a > 0 and rb > 0 then '' else t2 end as t3 from v3),
v5a as (select problem_id, t1, t2, t3,
  coalesce(case when json_valid(t3) then json_type(t3) = 'OBJECT' else false end, false) as valid from v4),
v5 as (select problem_id, t1, t2, case when valid then t3 else '{{}}' end as t3, valid from v5a),
v6 as (select *,
  valid and json_extract_string(t3, '$.winner') is not null
        and {D("json_extract(t3, '$.model_a_scores.total')")} is not null
        and {D("json_extract(t3, '$.model_b_scores.total')")} is not null as ok from v5),
pv as (select problem_id, ok,
  case when ok then json_extract_string(t3, '$.winner') else 'Error' end as winner,
  case when ok then json_extract_string(t3, '$.reason')
       when valid then coalesce(json_extract_string(t3, '$.reason'), 'Error during judgment: missing ''winner'' or ''total''')
       else 'Error during judgment: invalid JSON' end as reason,
  json_extract_string(t3, '$.model_a_feedback') as fa,
  json_extract_string(t3, '$.model_b_feedback') as fb,
  {_scores("a", "a", criteria)},
  {_scores("b", "b", criteria)}
  from v6)"""


_VP_BODY = vp_body("verdicts", CRITERIA["3"])
_VP = "with " + _VP_BODY + "\n"
sql("verdict_parse", _VP + "select problem_id, ok as parsed_ok, winner, a_total, b_total, reason from pv")

sql("think_strip", _VP + f"""
select v0.problem_id, case when instr(t0, '<think>') > 0 and instr(t0, '</think>') > 0
  then {strip("string_split(t0, '</think>')[-1]")} else t0 end as after_think,
  v4.t1 as fence, v4.t3 as json_text from v0 join v4 on v0.problem_id = v4.problem_id""")

def _judged(rubric: str) -> str:
    """``ju`` (missing values null, as the report reads them) and ``jd`` (filled) over all problems."""
    sides = [(p, l, [*CRITERIA[rubric], "total"]) for p, l in (("base", "a"), ("sft", "b"))]
    name = lambda p, c: f"{p}_total_score" if c == "total" else f"{p}_{c}"
    raw = ", ".join(f"coalesce(pv.{l}_{c}, {D(0.0)}) as {name(p, c)}" if c == "total" else f"pv.{l}_{c} as {name(p, c)}"
                    for p, l, cs in sides for c in cs)
    full = ", ".join(f"coalesce({name(p, c)}, {D(0.0)}) as {name(p, c)}" for p, _, cs in sides for c in cs)
    return _GT.rstrip("\n") + ",\n" + vp_body("verdicts" if rubric == "3" else "verdicts_4", CRITERIA[rubric]) + f""", ju as (
  select g.problem_id, g.problem as question, g.ground_truth as ground_truth_answer,
    g.base_response as base_model_answer, g.sft_response as sft_model_answer,
    pv.fa as judge_response_base, pv.fb as judge_response_sft, {raw},
    coalesce(pv.winner, case when pv.ok is null then 'Error' end) as winner,
    coalesce(pv.reason, case when pv.ok is null then 'Error during judgment: invalid JSON' end) as reason
  from g left join pv on g.problem_id = pv.problem_id),
jd as (
  select problem_id, question, coalesce(ground_truth_answer, 'N/A') as ground_truth_answer, base_model_answer, sft_model_answer,
    coalesce(judge_response_base, 'N/A') as judge_response_base, coalesce(judge_response_sft, 'N/A') as judge_response_sft, {full},
    coalesce(winner, 'N/A') as winner, coalesce(reason, 'N/A') as reason from ju)
"""


_JD = _judged("3")
sql("verdict_flatten", _JD + "select * from jd")

_OUT = f"""cast(count_if(winner = 'Model B') as bigint) as sft_wins, cast(count_if(winner = 'Model A') as bigint) as base_wins,
  cast(count_if(winner = 'Tie') as bigint) as ties, cast(count_if(winner = 'Error') as bigint) as errors, count(*) as total_problems"""
sql("judge_outcomes", _JD + f""", o as (select {_OUT} from jd)
select *, {D('sft_wins')} / total_problems * 100 as sft_wins_pct, {D('base_wins')} / total_problems * 100 as base_wins_pct,
  {D('ties')} / total_problems * 100 as ties_pct, {D('errors')} / total_problems * 100 as errors_pct from o""")

sql("judge_averages", _JD + """
select avg(base_total_score) as avg_base_score, avg(sft_total_score) as avg_sft_score,
  avg(sft_total_score) - avg(base_total_score) as score_difference from jd""")

sql("judge_margin", _JD + f""", o as (select {_OUT} from jd),
m as (select *, case when sft_wins > base_wins then sft_wins - base_wins when base_wins > sft_wins
  then base_wins - sft_wins else 0 end as margin from o)
select sft_wins, base_wins, total_problems, margin,
  case when sft_wins > base_wins then 'tuned' when base_wins > sft_wins then 'base' else 'equal' end as finding,
  {D('margin')} / total_problems * 100 as margin_pct from m""")

sql("rubric_audit", _JD + f"""
select problem_id,
  base_correctness * {D(0.5)} + base_brevity * {D(0.25)} + base_clear_explanation * {D(0.25)} as base_weighted_total,
  base_total_score - (base_correctness * {D(0.5)} + base_brevity * {D(0.25)} + base_clear_explanation * {D(0.25)}) as base_total_gap,
  sft_correctness * {D(0.5)} + sft_brevity * {D(0.25)} + sft_clear_explanation * {D(0.25)} as sft_weighted_total,
  sft_total_score - (sft_correctness * {D(0.5)} + sft_brevity * {D(0.25)} + sft_clear_explanation * {D(0.25)}) as sft_total_gap
from jd""")


# ---- text cleanup ------------------------------------------------------------------

_PHRASES = [
    r"(?is)The final answer is[:\s]+(.+?)(?:\.|$)",
    r"(?is)Therefore[,\s]+(.+?)(?:\.|$)",
    r"(?is)Thus[,\s]+(.+?)(?:\.|$)",
    r"(?is)The (?:dual cone|answer|solution) is[:\s]+(.+?)(?:\.|$)",
    r"(?is)In conclusion[,\s]+(.+?)(?:\.|$)",
]
_ANS = "coalesce(" + ", ".join(
    f"case when regexp_matches(c1, '{p}') then {strip(f'regexp_extract(c1, {q(p)}, 1)')} end" for p in _PHRASES) + ")"
sql("answer_recovery", cte("responses") + f""", a as (
  select problem_id, model, regexp_replace(response, '\\\\{{4,}}', '\\\\\\\\', 'g') as c1 from responses),
b as (select problem_id, model, c1, {_ANS} as ans from a)
select problem_id, model,
  case when instr(c1, {q(SS)}) = 0 and instr(c1, {q(SE)}) = 0 and ans is not null
       then c1 || chr(10) || {q(SS)} || chr(10) || ans || chr(10) || {q(SE)} else c1 end as cleaned
from b""")

sql("answer_normalize", cte("responses") + f""", s as (
  select problem_id, model, {between('response', SS, SE)} as sol from responses)
select problem_id, model, {normalize('sol')} as normalized, {residue('sol')} as residue from s""")


# ---- numbering, window filter, budgets, second rubric, fence dialect, lookup --------

sql("problem_numbers", "select doc_id, row_number() over (order by n_chars, doc_id) as problem_number from documents")

sql("window_filter", cte("exercises") + f""", t as (
  select doc_id, {q(SYS + EOS)} || exercise_text || {q(RS)} || solution_text || {q(RE + SS + 'Proven.' + SE + EOS)} as text
  from exercises),
n as (select doc_id, cast({tokens('text')} as integer) as N from t)
select doc_id, N from n where N <= {K.MAX_SEQ}""")

sql("sequence_budget_nb", _RL_T + f"""
select m + 1 as max_prompt_length, {K.MAX_SEQ} - (m + 1) as max_completion_length, {K.MAX_SEQ} as max_seq_length from thr""")


def _prompt4_sql():
    from tessera.functions.prompts import JUDGE_PROMPT_4
    t = JUDGE_PROMPT_4
    for ph, c in (("<<problem>>", "problem"), ("<<ground_truth>>", "ground_truth"),
                  ("<<base_response>>", "base_response"), ("<<sft_response>>", "sft_response")):
        pre, t = t.split(ph, 1)
        yield q(pre)
        yield c
    yield q(t)


sql("judge_prompt_4", _GT + f"select problem_id, {' || '.join(_prompt4_sql())} as judge_prompt from g")

_FENCE = _VP_BODY.replace(
    "v4 as (select problem_id, t1, t2,",
    "v4_full as (select problem_id, t1, t2,").replace(
    "       when a > 0 and rb > 0 then '' else t2 end as t3 from v3),",
    "       when a > 0 and rb > 0 then '' else t2 end as t3 from v3),\n"
    f"v4 as (select problem_id, t1, t1 as t2, {strip('t1')} as t3 from v1),")
sql("verdict_parse_fence", "with " + _FENCE + "\nselect problem_id, ok as parsed_ok, winner, a_total, b_total, reason from pv")

sql("point_lookup", _EX_T + f""", tt as (
  select doc_id, exercise_number, row_number() over (order by approx_length, doc_id) as problem_number
  from t where doc_id in (select doc_id from test))
select problem_number, doc_id, exercise_number from tt where problem_number = 4""")

sql("sft_training_set", _SFT_T.replace("n as (select doc_id,", "n as (select doc_id, text,") +
    f"select doc_id, text, N from n where N <= {int(K.MAX_SEQ * K.TRUNCATE_RATIO)}")

sql("length_stats_by_lang", f"""
with n as (select lang, cast({tokens('text')} as integer) as N from documents)
select lang, min(N) as min_len, max(N) as max_len, avg(N) as mean_len, cast(median(N) as double) as median_len
from n group by lang""")


# ---- reports, second rubric, pairing ------------------------------------------------

def fill(template: str, **values: str) -> str:
    """The template's literal pieces and the named SQL expressions, concatenated."""
    parts = T._PLACEHOLDER.split(template)
    return " || ".join(q(x) if k % 2 == 0 else f"cast({values[x]} as varchar)" for k, x in enumerate(parts) if k % 2 or x)


def lines(*blocks: tuple[int, str, str, str]) -> str:
    """Report blocks: (block, problem_id, text, from)."""
    return "\nunion all\n".join(f"select cast({b} as integer) as block, cast({p} as bigint) as problem_id, {t} as text {f}" for b, p, t, f in blocks)


def pct(n: str, total: str) -> str:
    return f"printf('%.1f', {D(n)} / {total} * 100)"


def case(key: str, texts: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when {q(k)} then {t}" for k, t in texts.items()) + " end"


_BASE, _TUNED, _JUDGE = (q(x) for x in K.REPORT_NAMES)


def _side(prefix: str, title: str) -> str:
    checks = dict(has_reasoning_end=RE, has_solution_start=SS, has_solution_end=SE)
    return fill(T.CMP_SIDE, title=q(title), response=f"{prefix}_response", status=f"case when {prefix}_ok then 'PASS' else 'FAIL' end",
                reasoning_end=q(RE), solution_start=q(SS), solution_end=q(SE),
                **{k: f"case when {contains(f'{prefix}_response', tag)} then 'True' else 'False' end" for k, tag in checks.items()})


_OUTCOME = ("case when sft_ok and not base_ok then 'tuned_only' when base_ok and sft_ok then 'both' "
            "when not base_ok and not sft_ok then 'neither' else 'base_only' end")
sql("comparison_report", _FC + f""", st as (
  select count_if(base_ok)::bigint as b, count_if(sft_ok)::bigint as t, count(*) as n, count_if(sft_ok)::bigint - count_if(base_ok)::bigint as i from p)
""" + lines(
    (0, "0", fill(T.CMP_HEADER, generated=q(K.GENERATED), base_name=_BASE, sft_name=_TUNED), ""),
    (1, "problem_id", fill(T.CMP_SECTION, problem_id="problem_id", problem="problem", base_side=f"({_side('base', 'BASE MODEL')})",
                           sft_side=f"({_side('sft', 'SFT MODEL')})", outcome=case(_OUTCOME, {k: q(v) for k, v in C.OUTCOME_TEXT.items()})), "from p"),
    (2, "0", fill(T.CMP_SUMMARY, base_correct="b", n="n", base_pct=pct("b", "n"), sft_correct="t", sft_pct=pct("t", "n"), improvement="i",
                  improvement_pct=pct("i", "n"), finding=case("case when i > 0 then 'improved' when i = 0 then 'equal' else 'decreased' end",
                                                              {k: f"({fill(v, improvement='i')})" for k, v in C.FINDING_TEXT.items()})), "from st")))


def _judge_report(rubric: str) -> str:
    counts = dict(sft_wins="s", base_wins="b", ties="t", errors="e", total="n", sft_wins_pct=pct("s", "n"), base_wins_pct=pct("b", "n"),
                  ties_pct=pct("t", "n"), errors_pct=pct("e", "n"), margin="abs(s - b)", margin_pct=pct("abs(s - b)", "n"))
    finding = "case when s > b then 'tuned' when b > s then 'base' else 'equal' end"
    choose = lambda texts: case(finding, {k: f"({fill(v, **counts)})" for k, v in texts.items()})
    cell = lambda c: (f"coalesce(case when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else cast({c} as varchar) end, 'N/A')")
    cells = lambda p: "(" + " || ' | ' || ".join(cell(f"{p}_{c}") for c in CRITERIA[rubric]) + ")"
    na = lambda c: f"coalesce({c}, 'N/A')"
    total = lambda p: f"printf('%.1f', coalesce({p}_total_score, 0.0))"
    return _judged(rubric) + """, st as (
  select count_if(winner = 'Model B')::bigint as s, count_if(winner = 'Model A')::bigint as b, count_if(winner = 'Tie')::bigint as t,
    count_if(winner = 'Error')::bigint as e, count(*) as n, avg(base_total_score) as avg_a, avg(sft_total_score) as avg_b from jd)
""" + lines(
        (0, "0", fill(T.JUDGE_HEADER, title=q(T.JUDGE_TITLE[rubric]), generated=q(K.GENERATED), base_name=_BASE, sft_name=_TUNED, judge_name=_JUDGE), ""),
        (1, "0", fill(T.JUDGE_SUMMARY, error_row=f"case when e > 0 then {fill(T.JUDGE_ERROR_ROW, **counts)} else '' end", finding=choose(T.JUDGE_FINDING),
                      avg_base="printf('%.2f', avg_a)", avg_sft="printf('%.2f', avg_b)", difference="printf('%+.2f', avg_b - avg_a)", **counts), "from st"),
        (2, "problem_id", fill(T.JUDGE_SECTION, problem_id="problem_id", question_preview=f"substr(question, 1, {T.PREVIEW_CHARS})",
                               table_head=q(T.JUDGE_TABLE_HEAD[rubric]), base_scores=cells("base"), sft_scores=cells("sft"), base_total=total("base"),
                               sft_total=total("sft"), winner=na("winner"), judge_response_base=na("judge_response_base"),
                               judge_response_sft=na("judge_response_sft"), reason=na("reason")), "from ju"),
        (3, "0", choose(T.JUDGE_CONCLUSION), "from st"))


sql("judge_report", _judge_report("3"))
sql("judge_report_4", _judge_report("4"))
sql("verdict_flatten_4", _judged("4") + "select * from jd")

_WEIGHTED = {p: " + ".join(f"{p}_{c} * {D(w)}" for c, w in RUBRIC_WEIGHTS["4"].items()) for p in ("base", "sft")}
sql("rubric_audit_4", _judged("4") + "select problem_id, " + ", ".join(
    f"{w} as {p}_weighted_total, {p}_total_score - ({w}) as {p}_total_gap" for p, w in _WEIGHTED.items()) + " from jd")

sql("attach_answers", """
select l_orderkey as prompt_id, l_linenumber as gen_id, o_orderpriority as answer from lineitem join orders on l_orderkey = o_orderkey""")

sql("document_head", "select doc_id, n_chars from documents order by n_chars, doc_id limit 5")

# the fixture's entities, the ampersand last
_UNESCAPED = "replace(replace(replace(response, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
sql("response_cleanup", ORACLE["answer_recovery"].replace("regexp_replace(response,", f"regexp_replace({_UNESCAPED},"))


# ---- HTML ---------------------------------------------------------------------------

_NAMES = ", ".join(f"({q(k)}, {q(v)})" for k, v in H.html5.items())
_REPAIRED = ", ".join(f"({k}, {v})" for k, v in H.repaired().items())
sql("html_unescape", f"""
with names(name, value) as (values {_NAMES}),
repaired(cp, other) as (values {_REPAIRED}),
pieces as (
  select page_id, unnest(string_split(html, '&')) as p, generate_subscripts(string_split(html, '&'), 1) as i from pages),
cut as (
  select page_id, i, p, case when i = 1 then '' else regexp_extract(p, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)', 1) end as ref from pieces),
refs as (
  select ref, ref[1] = '#' as numeric, ref[2] in ('x', 'X') as hex,
    regexp_extract(ref, '^#[xX]0*([0-9a-fA-F]*)', 1) as h, regexp_extract(ref, '^#0*([0-9]*)', 1) as n from (select distinct ref from cut where ref <> '') r),
points as (
  select ref, numeric, case when not numeric then 0 when hex then case when length(h) > 8 then 1114112 else ('0x0' || h)::bigint end
    else case when length(n) > 8 then 1114112 else ('0' || n)::bigint end end as cp from refs),
heads as (
  select ref, name, value from (
    select ref, name, value, row_number() over (partition by ref order by length(name) desc) as k
    from points join names on not numeric and starts_with(ref, name) and name not like '%;') x where k = 1),
decoded as (
  select points.ref, case
    when numeric and other is not null then chr(other::int)
    when numeric and (cp between 55296 and 57343 or cp > 1114111) then chr(65533)
    when numeric and (cp between 1 and 8 or cp = 11 or cp between 14 and 31 or cp = 127 or cp between 64976 and 65007 or cp % 65536 >= 65534) then ''
    when numeric then chr(cp::int)
    when names.value is not null then names.value
    when heads.value is not null then heads.value || substr(points.ref, length(heads.name) + 1)
    else '&' || points.ref end as text
  from points left join repaired using (cp) left join names on not numeric and names.name = points.ref left join heads on heads.ref = points.ref),
joined as (
  select page_id, string_agg(case when i = 1 then p when ref = '' then '&' || p else text || substr(p, length(ref) + 1) end, '' order by i) as text
  from cut left join decoded using (ref) group by page_id)
select page_id, length(html)::int as raw_chars, length(text)::int as unescaped_chars, md5(text) as unescaped_md5 from joined join pages using (page_id)""")


# ---- any number of models ------------------------------------------------------------

_FC4 = cte("responses_4") + f""", fc as (
  select problem_id, model, list_position({list(K.MODELS)!r}, model) as k,
    coalesce({contains('response', RE)} and {contains('response', SS)} and {contains('response', SE)}, false) as format_ok from responses_4),
pr as (
  select a.problem_id, a.model as base, b.model as tuned, a.format_ok as base_ok, b.format_ok as tuned_ok
  from fc a join fc b on a.problem_id = b.problem_id and a.k < b.k)
"""
sql("pair_outcomes_4", _FC4 + """
select *, case when tuned_ok and not base_ok then 'tuned_only' when tuned_ok and base_ok then 'both'
  when not tuned_ok and not base_ok then 'neither' else 'base_only' end as outcome from pr""")
sql("pair_matrix", _FC4 + f""", c as (
  select base, tuned, count_if(base_ok and tuned_ok)::bigint as "both", count_if(base_ok and not tuned_ok)::bigint as base_only,
    count_if(tuned_ok and not base_ok)::bigint as tuned_only, count_if(not base_ok and not tuned_ok)::bigint as neither,
    count_if(base_ok)::bigint as base_correct, count_if(tuned_ok)::bigint as tuned_correct, count(*) as num_problems from pr group by base, tuned)
select *, {D('base_correct')} / num_problems as base_accuracy, {D('tuned_correct')} / num_problems as tuned_accuracy, tuned_correct - base_correct as improvement,
  case when tuned_correct > base_correct then 'improved' when tuned_correct = base_correct then 'equal' else 'decreased' end as finding from c""")

# ---- user rewards, message lists, answer hooks, pairing --------------------------------

sql("user_reward", _RW + f"""
select prompt_id, gen_id, reward_brevity, reward_format_approx + reward_brevity as total from (
  select prompt_id, gen_id, reward_format_approx,
    (case when length(completion) <= gen_id % 10 * 20 + 40 then {D(1.0)} else {D(0.0)} end + case when instr(completion, answer) > 0 then {D(0.5)} else {D(0.0)} end
     - case when instr(completion, cast(prompt_id as varchar)) > 0 then {D(0.25)} else {D(0.0)} end) as reward_brevity from tot) u""")

sql("message_rewards", _RW + f"""
select prompt_id, gen_id, case when gen_id % 4 = 3 then {D(0.0)} else reward_format_exact end as reward_format_exact,
  case when gen_id % 4 = 3 then {D(-3.0)} else reward_format_approx end as reward_format_approx,
  case when gen_id % 4 = 3 then {D(-2.0)} else reward_answer end as reward_answer,
  case when gen_id % 4 = 3 then {D(-1.5)} else reward_numbers end as reward_numbers from tot""")

sql("hash_answers", """
select item_id, case when item_id % 5 <> 0 then cast(item_id as varchar) end as answer from benchmark""")

sql("output_truth_pairs", cte("responses") + """
select problem_id, response, cast(n_chars as varchar) as truth from responses join documents on problem_id = doc_id where model = 'base'""")

# ---- written and read back --------------------------------------------------------------

sql("exercise_lines", cte("exercises") + """
select exercise_number, exercise_text, solution_text, row_number() over (partition by doc_id % 4 order by doc_id) as line_no from exercises""")

sql("comparison_roundtrip", _FC + f"""
select r.problem_id, r.problem, r.model, case r.model when 'base' then {q(K.REPORT_NAMES[0])} else {q(K.REPORT_NAMES[1])} end as model_name, r.response, fc.format_ok
from responses r join fc on r.problem_id = fc.problem_id and r.model = fc.model""")

sql("single_model_roundtrip", _FC + f"""
select r.problem_id, r.problem, r.response, fc.format_ok, {q(K.REPORT_NAMES[1])} as model_name, 'tuned' as model_type
from responses r join fc on r.problem_id = fc.problem_id and r.model = fc.model where r.model = 'tuned'""")

sql("judged_csv_roundtrip", ORACLE["verdict_flatten"])
sql("judged_table_roundtrip", ORACLE["verdict_flatten_4"])

sql("sft_source", cte("sft_raw") + "select expected_answer, problem, generated_solution from sft_raw")
sql("rl_source", "select item_id, text as prompt from benchmark where item_id % 2 = 1 and item_id % 3 <> 0")
sql("char_window", f"select doc_id, length(text)::int as N from documents where length(text) <= {K.MAX_SEQ}")
sql("model_slugs", "select 'org_' || source || '_' || lang as slug, count(*) as n from documents group by 1")
