"""Registered queries: one per operator family, each over the driver's tables.

Each query is a function ``(spark, sf_dir) -> DataFrame``. The matching
DuckDB oracle SQL lives in :mod:`tessera.plans.oracle`. Output columns are
flat (no arrays or structs) and aliased identically on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tags import DEFAULT_TAGS as TG
from tessera.functions import text as TX
from tessera.operators import compare as C
from tessera.operators import evaluate as E
from tessera.operators import judge as J
from tessera.operators import lengths as L
from tessera.operators import messages as M
from tessera.operators import rewards as R
from tessera.operators import split as S
from tessera.plans.fixtures import fixture, table
from tessera.session import checkpoint_dir
from tessera.sources import io as IO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries (shared with the oracle SQL).
SPLIT_RATIO, SPLIT_SEED = 0.9, 42
SHORTEST_N = 10
PERCENTILE = 90
MAX_SEQ = 2048
TRUNCATE_RATIO = 0.5
SAMPLE_EVERY = 7
PLAN = dict(batch_size=1, grad_accum=4, epochs=15)
MODELS = ("base", "tuned", "third", "fourth")
REPORT_NAMES, GENERATED = ("base-model", "tuned-model", "judge-model"), "2025-01-01 00:00:00"
# Values derived from a standard deviation are reported as DECIMAL(24,9).
DEC = "decimal(24,9)"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- chat rendering and messages --------------------------------------------------

@query
def chat_render(spark, d):
    """P7 over the turn table, two partial stages per conversation."""
    return M.render_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", TG)


@query
def chat_render_genprompt(spark, d):
    """P5 + P6: benchmark prompt -> [system, user] -> rendered generation prompt."""
    b = M.rl_messages(table(spark, d, "benchmark"), TG.system_prompt, prompt="text", out="prompt")
    return b.select("item_id", M.render("prompt", TG, add_generation_prompt=True).alias("prompt_text"))


@query
def message_prefix(spark, d):
    """P3 + P8 + P7: drop the answer turn and re-prompt."""
    m = M.sft_messages(fixture(spark, d, "sft_raw"), TG)
    return m.select("doc_id", M.render(M.message_prefix("Messages", 2), TG, True).alias("text"))


@query
def sft_messages(spark, d):
    """[system, user, assistant] with tagged thoughts and answer."""
    m = M.sft_messages(fixture(spark, d, "sft_raw"), TG)
    return m.select("doc_id", F.size("Messages").alias("n_messages"),
                    F.col("Messages")[1]["content"].alias("user_content"),
                    F.col("Messages")[2]["content"].alias("assistant_content"))


@query
def proof_messages(spark, d):
    """P4 + P7: proof rows rendered for training."""
    m = M.proof_messages(fixture(spark, d, "exercises"), TG)
    return m.select("doc_id", M.render("Messages", TG).alias("text"))


@query
def rl_messages(spark, d):
    """P5 + P9b: prompt messages and the answer column (identity extractor)."""
    b = table(spark, d, "benchmark").withColumn("solution", F.col("item_id").cast("string"))
    b = b.withColumn("answer", TX.answer_hook("solution"))
    m = M.rl_messages(b, TG.system_prompt, prompt="text", out="prompt")
    return m.select("item_id", F.size("prompt").alias("n_messages"),
                    F.col("prompt")[0]["role"].alias("first_role"),
                    F.col("prompt")[1]["content"].alias("user_content"), "answer")


@query
def numeric_filter(spark, d):
    """Keep rows whose answer parses as a number (pandas rule)."""
    return L.numeric_answer_filter(fixture(spark, d, "sft_raw")).select("doc_id", "expected_answer")


def _sft_lengths(spark, d) -> DataFrame:
    m = M.sft_messages(L.numeric_answer_filter(fixture(spark, d, "sft_raw")), TG)
    r = m.select("doc_id", M.render("Messages", TG).alias("text"))
    return L.with_length(r, "text", "N")


@query
def length_filter(spark, d):
    """P1 + P3 + P7 + P16 + P11: the SFT training set (ids and lengths)."""
    return L.length_filter(_sft_lengths(spark, d), "N", MAX_SEQ, TRUNCATE_RATIO).select("doc_id", "N")


@query
def length_stats(spark, d):
    """A2 over rendered proof texts."""
    m = M.proof_messages(fixture(spark, d, "exercises"), TG)
    n = L.with_length(m.select(M.render("Messages", TG).alias("text")), "text", "N")
    return L.length_stats(n, "N").select("min_len", "max_len", "mean_len",
                                         F.col("median_len").cast("double").alias("median_len"))


def _rl_lengths(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    return L.with_length(b.withColumn("pt", M.generation_prompt("text", TG)), "pt", "prompt_length")


@query
def length_percentile_filter(spark, d):
    """P16 + A3 + P13: drop prompts above the 90th percentile length."""
    return L.percentile_filter(_rl_lengths(spark, d), "prompt_length", PERCENTILE) \
            .select("item_id", "prompt_length")


@query
def sequence_budget(spark, d):
    """A3 + P14: prompt / completion budget."""
    thr = L.percentile_threshold(_rl_lengths(spark, d), "prompt_length", PERCENTILE)
    return L.sequence_budget(thr, MAX_SEQ, pad=0)


@query
def retention_counts(spark, d):
    """A4 for the numeric-answer filter."""
    from tessera.functions.numeric import is_number
    return L.retention_counts(fixture(spark, d, "sft_raw"), is_number("expected_answer"))


def _exercise_lengths(spark, d) -> DataFrame:
    ex = fixture(spark, d, "exercises")
    return ex.withColumn("approx_length", L.approx_length("exercise_text", "solution_text"))


@query
def training_plan(spark, d):
    """T2 + P18: steps for the training remainder of the shortest-10 split."""
    train, _ = S.shortest_split(_exercise_lengths(spark, d), "approx_length", "doc_id", SHORTEST_N)
    return L.training_plan(train, **PLAN)


@query
def shortest_n(spark, d):
    """The 10 shortest exercises by approximate length."""
    return S.shortest_n(_exercise_lengths(spark, d), "approx_length", "doc_id", SHORTEST_N) \
            .select("doc_id", "exercise_number", "approx_length")


@query
def shortest_n_remainder(spark, d):
    """Everything except the 10 shortest."""
    train, _ = S.shortest_split(_exercise_lengths(spark, d), "approx_length", "doc_id", SHORTEST_N)
    return train.select("doc_id", "approx_length")


@query
def exact_split_sizes(spark, d):
    """T3 + A7: exact-size seeded split of documents."""
    lab = S.label_split(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id",
                        SPLIT_RATIO, SPLIT_SEED)
    return S.split_summary(lab, "split", "n_chars")


@query
def exact_split_members(spark, d):
    """Membership of each document."""
    return S.label_split(table(spark, d, "documents").select("doc_id"), "doc_id", SPLIT_RATIO, SPLIT_SEED)


# ---- rewards -----------------------------------------------------------------------

def _completions(spark, d) -> DataFrame:
    return fixture(spark, d, "completions")


def _one_reward(spark, d, name, dialect="package"):
    s = R.score(_completions(spark, d), rewards=[name], dialect=dialect, total=None)
    return s.select("prompt_id", "gen_id", F.col("reward_" + name).alias("reward"))


@query
def reward_exact(spark, d):
    """R1."""
    return _one_reward(spark, d, "format_exact")


@query
def reward_approx(spark, d):
    """R2."""
    return _one_reward(spark, d, "format_approx")


@query
def reward_answer(spark, d):
    """R3."""
    return _one_reward(spark, d, "answer")


@query
def reward_numbers(spark, d):
    """R4."""
    return _one_reward(spark, d, "numbers")


@query
def reward_verdicts(spark, d):
    """Verdict label counts of the answer check."""
    v = R.with_answer_verdict(_completions(spark, d), "completion", "answer", TG, "verdict")
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def reward_total(spark, d):
    """R6 + A8: all four package rewards and their sum."""
    s = R.score(_completions(spark, d), rewards=R.enabled_rewards())
    return s.select("prompt_id", "gen_id", "reward_format_exact", "reward_format_approx",
                    "reward_answer", "reward_numbers", "total")


@query
def reward_group_stats(spark, d):
    """Reward mean / spread per prompt."""
    s = R.score(_completions(spark, d))
    g = R.group_stats(s, "prompt_id", "total")
    return g.select("prompt_id", "n", "n_null", "reward_mean", F.col("reward_std").cast(DEC).alias("reward_std"),
                    "reward_min", "reward_max")


@query
def group_advantage(spark, d):
    """Group-relative advantage per completion."""
    s = R.score(_completions(spark, d)).select("prompt_id", "gen_id", "total")
    a = R.group_advantage(s, "prompt_id", "total")
    return a.select("prompt_id", "gen_id", "total", F.col("advantage").cast(DEC).alias("advantage"))


@query
def reward_exact_nb(spark, d):
    """R7 (notebook dialect)."""
    return _one_reward(spark, d, "format_exact", "notebook")


@query
def reward_answer_nb(spark, d):
    """R9 (notebook dialect)."""
    return _one_reward(spark, d, "answer", "notebook")


@query
def reward_numbers_nb(spark, d):
    """R10 (notebook dialect)."""
    return _one_reward(spark, d, "numbers", "notebook")


@query
def debug_sample(spark, d):
    """Deterministic 1-in-7 debug sample with verdicts and previews."""
    return R.debug_sample(_completions(spark, d), SAMPLE_EVERY, ["prompt_id", "gen_id"], tags=TG)


# ---- evaluation ------------------------------------------------------------------

def _eval_rows(spark, d) -> DataFrame:
    s = R.score(_completions(spark, d), solution_out="_solution")
    return E.evaluate_rows(s, output="completion", truth="answer", tags=TG, solution="_solution").drop("_solution")


@query
def eval_rows(spark, d):
    """E1-E4 per completion."""
    return _eval_rows(spark, d).select("prompt_id", "gen_id", "format_correct", "answer_correct",
                                       "has_reasoning", "reasoning_length")


@query
def eval_metrics(spark, d):
    """A1/E5: batch metrics with the total reward."""
    return E.metrics(_eval_rows(spark, d), reward="total")


@query
def eval_metrics_by_group(spark, d):
    """A1 grouped by expected answer."""
    return E.metrics(_eval_rows(spark, d), reward="total", by=["answer"])


# ---- comparison -----------------------------------------------------------------

def _responses(spark, d) -> DataFrame:
    return C.with_format_check(fixture(spark, d, "responses"), "response", tags=TG)


@query
def format_check(spark, d):
    """Three-tag format check per response."""
    return _responses(spark, d).select("problem_id", "model", "format_check.*")


def _pairs(spark, d) -> DataFrame:
    return C.pair_models(_responses(spark, d), "base", "tuned", "problem_id", "model")


@query
def pair_outcome(spark, d):
    """J2 + C2: pair base and tuned per problem; outcome label."""
    p = _pairs(spark, d)
    b, t = F.col("base_format_check.format_ok"), F.col("sft_format_check.format_ok")
    return p.select("problem_id", b.alias("base_ok"), t.alias("sft_ok"),
                    C.pair_outcome(b, t).alias("outcome"))


@query
def pair_summary(spark, d):
    """A5 + C3: pass counts, accuracies, improvement, finding."""
    return C.pair_summary(_pairs(spark, d))


@query
def single_summary(spark, d):
    """A6 per model."""
    return C.single_summary(_responses(spark, d), by=["model"])


# ---- judge --------------------------------------------------------------------------

def _with_truth(spark, d) -> DataFrame:
    pairs = _pairs(spark, d).select("problem_id", "problem", "base_response", "sft_response")
    asked = fixture(spark, d, "responses").select("problem")
    return J.late_ground_truth(pairs, fixture(spark, d, "exercises"), "problem", order="doc_id", wanted=asked)


@query
def ground_truth_lookup(spark, d):
    """S4 + J1: last-wins lookup by exact problem text, with default."""
    return _with_truth(spark, d).select("problem_id", "ground_truth")


@query
def judge_prompt(spark, d):
    """Three-criteria judge prompt per problem."""
    return J.judge_prompts(_with_truth(spark, d)).select("problem_id", "judge_prompt")


def _parsed(spark, d) -> DataFrame:
    return J.parse_verdicts(fixture(spark, d, "verdicts"), "raw", "3", "full")


@query
def verdict_parse(spark, d):
    """D4 + D5: parse raw judge replies."""
    p = _parsed(spark, d)
    v = F.col("verdict")
    return p.select("problem_id", F.col("parse_error").isNull().alias("parsed_ok"),
                    v["winner"].alias("winner"),
                    v["model_a_scores"]["total"].alias("a_total"),
                    v["model_b_scores"]["total"].alias("b_total"),
                    v["reason"].alias("reason"))


def _judged(spark, d, rubric="3", fill=True) -> DataFrame:
    """Every problem; one without a reply is an error."""
    replies = fixture(spark, d, "verdicts" if rubric == "3" else "verdicts_4")
    parsed = J.parse_verdicts(_with_truth(spark, d).join(replies, "problem_id", "left"), "raw", rubric, "full")
    return J.flatten_verdicts(parsed, rubric=rubric, fill=fill)


@query
def verdict_flatten(spark, d):
    """The 17-column judged table."""
    return _judged(spark, d)


@query
def judge_outcomes(spark, d):
    """Outcome counts and percentages."""
    return J.judge_outcomes(_judged(spark, d))


@query
def judge_averages(spark, d):
    """Average totals and difference."""
    return J.judge_averages(_judged(spark, d))


@query
def judge_margin(spark, d):
    """Margin and finding."""
    m = J.judge_margin(J.judge_outcomes(_judged(spark, d)))
    return m.select("sft_wins", "base_wins", "total_problems", "margin", "finding", "margin_pct")


@query
def rubric_audit(spark, d):
    """Weighted-total audit per problem."""
    a = J.rubric_audit(_judged(spark, d), "3")
    return a.select("problem_id", "base_weighted_total", "base_total_gap", "sft_weighted_total",
                    "sft_total_gap")


# ---- text cleanup ------------------------------------------------------------------

@query
def answer_recovery(spark, d):
    """F13 + F14: backslash collapse and untagged-answer recovery."""
    r = fixture(spark, d, "responses").withColumn("_c", TX.collapse_backslashes("response"))
    cleaned = TX.recover_untagged_answer(F.col("_c"), TG.solution_start, TG.solution_end)
    return r.select("problem_id", "model", cleaned.alias("cleaned"))


@query
def think_strip(spark, d):
    """F1 + F2 on solutions; F17 on judge replies."""
    v = fixture(spark, d, "verdicts").withColumn("_t0", TX.strip("raw"))
    v = v.withColumns({"after_think": TX.after_last_think(F.col("_t0")), "fence": TX.fence_body(F.col("_t0"))})
    v = J.with_verdict_json_text(v, "raw", "full", "json_text")
    return v.select("problem_id", "after_think", "fence", "json_text")


@query
def answer_normalize(spark, d):
    """F9 + F11 on extracted solutions."""
    r = fixture(spark, d, "responses").withColumn("_sol", R.solution("response", TG))
    return r.select("problem_id", "model", TX.normalize_answer(F.col("_sol")).alias("normalized"),
                    TX.numeric_residue(F.col("_sol")).alias("residue"))


@query
def html_unescape(spark, d):
    """F12 on whole raw pages."""
    from tessera.functions.html import unescape
    p = table(spark, d, "pages").select("page_id", "html", unescape("html").alias("text"))
    return p.select("page_id", F.length("html").alias("raw_chars"), F.length("text").alias("unescaped_chars"), F.md5("text").alias("unescaped_md5"))


@query
def comparison_report(spark, d):
    """Markdown comparison report lines."""
    from tessera.sources.report import comparison_report_lines
    return comparison_report_lines(_pairs(spark, d), *REPORT_NAMES[:2], generated=GENERATED)


@query
def judge_report(spark, d):
    """Markdown judge report lines."""
    from tessera.sources.report import judge_report_lines
    return judge_report_lines(_judged(spark, d, fill=False), *REPORT_NAMES, generated=GENERATED)


@query
def judge_report_4(spark, d):
    """The report on four criteria."""
    from tessera.sources.report import judge_report_lines
    return judge_report_lines(_judged(spark, d, "4", fill=False), *REPORT_NAMES, generated=GENERATED, rubric="4")


@query
def verdict_flatten_4(spark, d):
    """The judged table on four criteria."""
    return _judged(spark, d, "4")


@query
def rubric_audit_4(spark, d):
    """Weighted-total audit on four criteria."""
    a = J.rubric_audit(_judged(spark, d, "4"), "4")
    return a.select("problem_id", "base_weighted_total", "base_total_gap", "sft_weighted_total", "sft_total_gap")


@query
def attach_answers(spark, d):
    """Each line of an order with the order's priority as its expected answer."""
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.col("o_orderpriority").alias("answer"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("gen_id"))
    return R.attach_answers(lines, prompts)


@query
def document_head(spark, d):
    """T5: the first five documents by length."""
    return S.head(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 5)


# ---- numbering, window filter, budgets, second rubric, fence dialect, lookup --------

@query
def problem_numbers(spark, d):
    """Dense 1-based numbering by (length, id) without a single-partition window."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return C.number_rows(docs, ["n_chars", "doc_id"], "problem_number").select("doc_id", "problem_number")


@query
def window_filter(spark, d):
    """P4 + P7 + P16 + P12: proof rows that fit the full window."""
    m = M.proof_messages(fixture(spark, d, "exercises"), TG)
    n = L.with_length(m.select("doc_id", M.render("Messages", TG).alias("text")), "text", "N")
    return L.window_filter(n, "N", MAX_SEQ).select("doc_id", "N")


@query
def sequence_budget_nb(spark, d):
    """P14, notebook form: one extra token of prompt headroom."""
    thr = L.percentile_threshold(_rl_lengths(spark, d), "prompt_length", PERCENTILE)
    return L.sequence_budget(thr, MAX_SEQ, pad=1)


@query
def judge_prompt_4(spark, d):
    """Four-criteria judge prompt per problem."""
    return J.judge_prompts(_with_truth(spark, d), rubric="4").select("problem_id", "judge_prompt")


@query
def verdict_parse_fence(spark, d):
    """D3 + D5: fence-only parsing dialect."""
    p = J.parse_verdicts(fixture(spark, d, "verdicts"), "raw", "3", "fence")
    v = F.col("verdict")
    return p.select("problem_id", F.col("parse_error").isNull().alias("parsed_ok"),
                    v["winner"].alias("winner"), v["model_a_scores"]["total"].alias("a_total"),
                    v["model_b_scores"]["total"].alias("b_total"), v["reason"].alias("reason"))


@query
def point_lookup(spark, d):
    """T2 + T4: the fourth of the ten shortest exercises, by index."""
    shortest = S.numbered_top(_exercise_lengths(spark, d).select("approx_length", "doc_id", "exercise_number"),
                              ["approx_length", "doc_id"], SHORTEST_N)
    return S.point_lookup(shortest, 3).select("problem_number", "doc_id", "exercise_number")


@query
def sft_training_set(spark, d):
    """The SFT trainer input table (rendered text and its length, filtered)."""
    return L.length_filter(_sft_lengths(spark, d), "N", MAX_SEQ, TRUNCATE_RATIO).select("doc_id", "text", "N")


@query
def response_cleanup(spark, d):
    """unescape, backslash collapse, answer recovery."""
    from tessera.functions.html import clean_responses
    r = clean_responses(fixture(spark, d, "responses"), "response", TG.solution_start, TG.solution_end)
    return r.select("problem_id", "model", "cleaned")


@query
def length_stats_by_lang(spark, d):
    """A2 grouped: token-length statistics of whole documents per language."""
    n = L.with_length(table(spark, d, "documents").select("lang", "text"), "text", "N")
    return L.length_stats(n, "N", by=["lang"]).select(
        "lang", "min_len", "max_len", "mean_len", F.col("median_len").cast("double").alias("median_len"))


# ---- any number of models ------------------------------------------------------------

def _responses_4(spark, d) -> DataFrame:
    return C.with_format_check(fixture(spark, d, "responses_4"), "response", tags=TG)


@query
def pair_matrix(spark, d):
    """J2 + A5 + C3 over four models: outcome counts, accuracies and finding of each two."""
    return C.pair_matrix(_responses_4(spark, d), MODELS)


@query
def pair_outcomes_4(spark, d):
    """J2 + C2 over four models: outcome per problem and two models that both answer it."""
    return C.pair_outcomes(_responses_4(spark, d), MODELS)


# ---- user rewards, message lists, answer hooks, pairing --------------------------------

def brevity(prompts, completions, answer, budget, **kwargs):
    """A user reward: short completions (``budget`` characters) that hold the answer and do not repeat the prompt."""
    out = []
    for p, c, a, b in zip(prompts, completions, answer, budget):
        text = c[0]["content"]
        short = 1.0 if len(text) <= b else 0.0
        out.append(short + (0.5 if a is not None and a in text else 0.0) - (0.25 if p[0]["content"] in text else 0.0))
    return out


@query
def user_reward(spark, d):
    """A user reward over prompts, completions, answers and a further column, each prompt's completions in one call."""
    c = _completions(spark, d).withColumns({"prompt": F.col("prompt_id").cast("string"), "budget": F.col("gen_id") % 10 * 20 + 40})
    s = R.score(c, rewards=["format_approx"], user_rewards={"brevity": brevity}, prompt="prompt", group="prompt_id", extra=["budget"])
    return s.select("prompt_id", "gen_id", "reward_brevity", "total")


@query
def message_rewards(spark, d):
    """F27 + R1-R4: completions as message lists, some empty; the first message counts."""
    m = F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content"))
    more = F.struct(F.lit("user").alias("role"), F.lit("<SOLUTION>0</SOLUTION>").alias("content"))
    c = _completions(spark, d).withColumn("completion", F.when(F.col("gen_id") % 4 == 3, F.array().cast("array<struct<role:string,content:string>>"))
                                          .otherwise(F.array(m, more)))
    s = R.score(c)
    return s.select("prompt_id", "gen_id", "reward_format_exact", "reward_format_approx", "reward_answer", "reward_numbers")


@query
def hash_answers(spark, d):
    """P9 + P9b: the solution column renamed, the answer after the first ``####``."""
    i = F.col("item_id")
    marked = F.concat(F.lit("Steps of "), i, F.lit(" ####  "), i, F.when(i % 3 == 0, F.lit(" #### tail")).otherwise(F.lit(" ")))
    b = table(spark, d, "benchmark").select("item_id", F.when(i % 5 == 0, F.lit("no marker")).otherwise(marked).alias("solution"))
    return M.rename_solution_to_answer(b).select("item_id", TX.answer_hook("answer", "####").alias("answer"))


@query
def output_truth_pairs(spark, d):
    """Outputs and truths paired strictly on the key."""
    outputs = fixture(spark, d, "responses").where("model = 'base'").select("problem_id", "response")
    truths = table(spark, d, "documents").select(F.col("doc_id").alias("problem_id"), F.col("n_chars").cast("string").alias("truth"))
    return E.pair_outputs_truths(outputs, truths, "problem_id")


# ---- written and read back --------------------------------------------------------------

def _folder(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


@query
def exercise_lines(spark, d):
    """S3: exercises as JSON Lines in four files, each a folder of as many parts as tasks write it; each row with its line number in its file."""
    path = _folder(spark, "exercises")
    ex = fixture(spark, d, "exercises").withColumn("part", F.col("doc_id") % 4)
    ex.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id").write.partitionBy("part").json(path)
    return IO.read_exercise_lines(spark, path, in_parts=True).select("exercise_number", "exercise_text", "solution_text", "line_no")


@query
def comparison_roundtrip(spark, d):
    """S6 + S5: comparison results written, and read back as one row per problem and model."""
    path = _folder(spark, "comparison")
    pairs = _pairs(spark, d)
    IO.write_comparison(pairs, C.pair_summary(pairs), path, *REPORT_NAMES[:2], timestamp=GENERATED)
    back = IO.read_comparison(spark, path)
    return back.select("problem_id", "problem", "model", "model_name", "response", F.col("format_check.format_ok").alias("format_ok"))


@query
def single_model_roundtrip(spark, d):
    """One model's results written and read back."""
    path = _folder(spark, "single")
    own = _responses(spark, d).where("model = 'tuned'")
    IO.write_single_model(own, C.single_summary(own), path, REPORT_NAMES[1], "tuned", timestamp=GENERATED)
    back = IO.read_single_model(spark, path)
    return back.select("problem_id", "problem", "response", F.col("format_check.format_ok").alias("format_ok"), "model_name", "model_type")


@query
def judged_csv_roundtrip(spark, d):
    """The judged table as quoted CSV with multi-line texts, read back by many tasks."""
    path = _folder(spark, "judged-csv")
    judged = _judged(spark, d)
    IO.write_judged_csv(judged, path)
    return IO.read_judged_csv(spark, path, judged.schema)


@query
def judged_table_roundtrip(spark, d):
    """The judged table on four criteria, stored and read back."""
    path = _folder(spark, "judged")
    IO.write_judged_table(_judged(spark, d, "4"), path)
    return spark.read.parquet(path)


@query
def sft_source(spark, d):
    """A stored SFT table with further columns, read as its three."""
    path = _folder(spark, "sft-source")
    fixture(spark, d, "sft_raw").write.parquet(path)
    return IO.load_sft(spark, path)


@query
def rl_source(spark, d):
    """Prompts stored by config and split; one of each is read."""
    path = _folder(spark, "rl-source")
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"), F.concat(F.lit("c"), F.col("item_id") % 2).alias("config"),
                                            F.when(F.col("item_id") % 3 == 0, "test").otherwise("train").alias("split"))
    b.write.partitionBy("config", "split").parquet(path)
    return IO.load_rl(spark, path, config="c1", split="train").select("item_id", "prompt")


@query
def char_window(spark, d):
    """U4 + P16 + P12: another length function; documents of at most the window's characters."""
    n = L.with_length(table(spark, d, "documents").select("doc_id", "text"), "text", "N", length_fn="chars")
    return L.window_filter(n, "N", MAX_SEQ).select("doc_id", "N")


@query
def model_slugs(spark, d):
    """Names as they stand in output paths, and how many documents each has."""
    name = F.concat(F.lit("org/"), F.col("source"), F.lit("."), F.col("lang"))
    return table(spark, d, "documents").groupBy(TX.slug(name).alias("slug")).agg(F.count(F.lit(1)).alias("n"))
