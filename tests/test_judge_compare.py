"""C1-C3, J1, J2, W1, D1-D10, S4."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.prompts import JUDGE_PROMPT_3, JUDGE_PROMPT_4
from tessera.operators import compare as C
from tessera.operators import judge as J

VERDICT = {"model_a_scores": {"correctness": 8, "brevity": 6, "clear_explanation": 7, "total": 7.25},
           "model_b_scores": {"correctness": 9, "brevity": 8, "clear_explanation": 8, "total": 8.5},
           "model_a_feedback": "ok", "model_b_feedback": "good", "winner": "Model B", "reason": "r"}


def raw_cases():
    j = json.dumps(VERDICT)
    return [
        (1, j, "Model B"),
        (2, "Here:\n```json\n" + j + "\n```", "Model B"),
        (3, "<think>hmm</think>\n" + j, "Model B"),
        (4, "Verdict: " + j + " End.", "Model B"),
        (5, "I cannot decide.", "Error"),
        (6, json.dumps({"model_a_scores": {"correctness": 1}, "model_b_scores": {"correctness": 2},
                        "winner": "Model B"}), "Error"),
        (7, j + " trailing {\"x\": 1}", "Error"),
        (8, "{'single': 'quotes'}", "Error"),
        (9, "<think>```{\"winner\": \"Tie\"}```</think>" + j, "Error"),
    ]


def test_parse_verdicts(spark):
    df = spark.createDataFrame([(i, r) for i, r, _ in raw_cases()], "problem_id long, raw string")
    got = {r.problem_id: r for r in J.parse_verdicts(df).collect()}
    for i, _, want in raw_cases():
        v = got[i].verdict
        assert v.winner == want, (i, v)
        if want == "Error":
            assert v.model_a_scores.total == 0.0 and v.reason.startswith("Error during judgment: ")
            assert got[i].parse_error is not None
        else:
            assert v.model_b_scores.total == 8.5 and got[i].parse_error is None


def test_verdict_without_total_keeps_its_fields(spark):
    raw = json.dumps({**VERDICT, "model_b_scores": {"correctness": 9}})
    v = J.parse_verdicts(spark.createDataFrame([(1, raw)], "problem_id long, raw string")).first()
    assert v.verdict.winner == "Error" and v.verdict.model_b_scores.total == 0.0 and v.verdict.model_a_scores.total == 7.25
    assert v.verdict.model_b_scores.correctness == 9 and v.verdict.model_a_feedback == "ok" and v.verdict.reason == "r"
    assert v.parse_error == "missing 'winner' or 'total'"


def test_json_check_of_the_jvm(spark):
    j = json.dumps(VERDICT)
    cases = [(j, True), (j + "x", False), (j + "," + j, False), (f"[{j}]", False), ("{'a':1}", False), ('{"a":01}', False), ('{"a":1,}', False),
             ("", False), (None, False), ("  " + j + "\n", True), ('{"a":1},"end of the verdict"', False), ('{"a":"]"}', True), ('{"a":1}]', False), ("1", False)]
    df = spark.createDataFrame(cases, "t string, want boolean").select("*", J.is_json_object(F.col("t")).alias("got"))
    for r in df.collect():
        assert r.got == r.want, r.t
    # refused here, accepted by Python's rules
    v = J.parse_verdicts(spark.createDataFrame([(j[:-1] + ', "reason": "again"}',)], "raw string")).first()
    assert v.parse_error is None and v.verdict.winner == "Model B"


def test_fence_dialect(spark):
    df = spark.createDataFrame([(1, "```json\n" + json.dumps(VERDICT) + "\n```"), (2, "x {" + json.dumps(VERDICT))],
                               "problem_id long, raw string")
    got = {r.problem_id: r.verdict.winner for r in J.parse_verdicts(df, dialect="fence").collect()}
    assert got == {1: "Model B", 2: "Error"}


def test_flatten_outcomes_audit(spark):
    df = spark.createDataFrame([(i, r, f"q{i}", "gt", "b", "s") for i, r, _ in raw_cases()],
                               "problem_id long, raw string, problem string, ground_truth string, "
                               "base_response string, sft_response string")
    flat = J.flatten_verdicts(J.parse_verdicts(df))
    assert len(flat.columns) == 17
    rows = {r.problem_id: r for r in flat.collect()}
    assert rows[5].judge_response_base == "N/A" and rows[5].base_correctness == 0.0
    assert rows[1].base_correctness == 8.0
    o = J.judge_outcomes(flat).first()
    assert (o.sft_wins, o.base_wins, o.ties, o.errors, o.total_problems) == (4, 0, 0, 5, 9)
    m = J.judge_margin(J.judge_outcomes(flat)).first()
    assert m.finding == "tuned" and m.margin == 4
    a = J.judge_averages(flat).first()
    assert a.avg_sft_score == pytest.approx(8.5 * 4 / 9)
    audit = {r.problem_id: r for r in J.rubric_audit(flat).collect()}
    assert audit[1].base_weighted_total == pytest.approx(7.25) and audit[1].base_total_gap == pytest.approx(0)
    s = J.judge_summary(flat).first()
    assert (s.sft_wins, s.errors, s.margin) == (4, 5, 4)


def test_prompts_contain_inputs(spark):
    df = spark.createDataFrame([("P?", "G!", "B.", "S,")], "problem string, ground_truth string, "
                                                            "base_response string, sft_response string")
    p3 = J.judge_prompts(df).first().judge_prompt
    assert p3 == JUDGE_PROMPT_3.replace("<<problem>>", "P?").replace("<<ground_truth>>", "G!") \
        .replace("<<base_response>>", "B.").replace("<<sft_response>>", "S,")
    p4 = J.judge_prompts(df, rubric="4").first().judge_prompt
    assert "Format Adherence** (30%)" in p4 and "P?" in p4 and "<<" not in p4 and "<<" not in JUDGE_PROMPT_4.replace("<<problem>>", "")[:0]


def test_ground_truth_last_wins(spark):
    ex = spark.createDataFrame([("a", "s1", 1), ("a", "s2", 2), ("b", "t", 3)],
                               "exercise_text string, solution_text string, line_no long")
    res = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "problem_id long, problem string")
    got = {r.problem_id: r.ground_truth for r in J.with_ground_truth(res, J.last_wins_lookup(ex)).collect()}
    assert got == {1: "s2", 2: "t", 3: "Ground truth not found"}


def test_pairing_and_outcomes(spark):
    rows = [(1, "base", "p", "<end_working_out><SOLUTION>1</SOLUTION>"), (1, "tuned", "p", "plain"),
            (2, "base", "q", "plain"), (2, "tuned", "q", "<end_working_out><SOLUTION>2</SOLUTION>"),
            (3, "base", "r", "x")]
    res = C.with_format_check(spark.createDataFrame(rows, "problem_id long, model string, problem string, response string"))
    pairs = C.pair_models(res)
    assert pairs.count() == 2
    out = {r.problem_id: r.o for r in pairs.select("problem_id", C.pair_outcome(
        F.col("base_format_check.format_ok"), F.col("sft_format_check.format_ok")).alias("o")).collect()}
    assert out == {1: "base_only", 2: "tuned_only"}
    s = C.pair_summary(pairs).first()
    assert (s.base_model_correct, s.sft_model_correct, s.improvement, s.finding) == (1, 1, 0, "equal")
    single = {r.model: (r.correct_format, r.num_problems) for r in C.single_summary(res, by=["model"]).collect()}
    assert single == {"base": (1, 3), "tuned": (1, 2)}


def test_pairing_starts_no_job(spark, sf):
    from tessera.plans.catalog import QUERIES
    group = "pairing-builds"
    spark.sparkContext.setJobGroup(group, "build only")
    for name in ("pair_outcome", "judge_prompt", "comparison_report"):
        QUERIES[name](spark, sf)
    stages = [s for j in spark.sparkContext.statusTracker().getJobIdsForGroup(group)
              for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) <= 12  # one schema read for each Parquet table reader, none over rows


def test_number_rows_dense_and_ordered(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars").repartition(5)
    got = sorted((r.problem_number, r.n_chars, r.doc_id) for r in
                 C.number_rows(docs, ["n_chars", "doc_id"], partitions=4).collect())
    want = sorted((r.n_chars, r.doc_id) for r in docs.collect())
    assert [g[0] for g in got] == list(range(1, len(want) + 1))
    assert [(g[1], g[2]) for g in got] == want


def test_pairing_rejects_duplicate_keys(spark):
    rows = [(1, "base", "p", "a"), (1, "base", "p", "b"), (1, "tuned", "p", "c")]
    res = C.with_format_check(spark.createDataFrame(rows, "problem_id long, model string, problem string, response string"))
    with pytest.raises(Exception, match="a key occurs 2 times"):
        C.pair_models(res).collect()


def test_number_rows_many_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    got = sorted((r.problem_number, r.doc_id) for r in
                 C.number_rows(docs, ["doc_id"], partitions=40).collect())
    assert [g[0] for g in got] == list(range(1, docs.count() + 1))
    assert [g[1] for g in got] == sorted(r.doc_id for r in docs.collect())
