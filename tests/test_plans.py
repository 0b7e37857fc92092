"""Plan-shape checks on every registered query (scale rules)."""

import pytest

import __spark_entry__ as E
from tessera.plans.catalog import QUERIES

SF01 = "/root/testdata/sf0.01"
#: windows over ranges, and over the cut records of a file: what each is partitioned by
WINDOW_OK = {"problem_numbers": "_range", "judged_csv_roundtrip": "file"}
PYTHON_OK = {"user_reward", "judged_csv_roundtrip", "judged_table_roundtrip", "verdict_parse", "verdict_flatten", "judge_outcomes", "judge_averages",
             "judge_margin", "rubric_audit", "judge_report", "verdict_parse_fence", "judge_report_4", "verdict_flatten_4", "rubric_audit_4"}


def plan_of(spark, name):
    df = E.queries()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = plan_of(spark, name)
    assert "BatchEvalPython" not in plan, "row-at-a-time Python UDF"
    assert "RoundRobinPartitioning" not in plan, "inputs are dealt out by a caller's option only"
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, "cross join"
    if name not in PYTHON_OK:
        assert "ArrowEvalPython" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if line.strip(" :+-").startswith("Window "):
            assert name in WINDOW_OK, (name, "window in a registered query")
            assert f"], [{WINDOW_OK[name]}#" in line, (name, "window over all rows")
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            # above a partial (map-side) aggregate: one small row per task
            assert "partial_" in child or "Aggregate(keys=[]" in child, (name, line, child)


def test_scan_pruning(spark):
    plan = plan_of(spark, "reward_total")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    plan = plan_of(spark, "ground_truth_lookup")
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


def test_chat_render_splits_hot_conversations(spark):
    plan = plan_of(spark, "chat_render")
    exchanges = [l for l in plan.splitlines() if "Exchange hashpartitioning" in l]
    # first (lower) exchange is keyed by (conversation, chunk), the second by conversation
    assert len(exchanges) == 2 and "_c#" in exchanges[1] and "_c#" not in exchanges[0]


@pytest.mark.parametrize("name", ["reward_exact", "reward_approx", "reward_answer", "reward_numbers",
                                  "reward_total", "reward_exact_nb", "reward_answer_nb", "reward_numbers_nb"])
def test_scoring_is_narrow(spark, name):
    plan = plan_of(spark, name)
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan


def test_text_join_leads_with_hash(spark):
    plan = plan_of(spark, "ground_truth_lookup")
    join = [l for l in plan.splitlines() if "LeftOuter" in l][0]
    assert "_h#" in join.split("[")[1]


def final_plan(df):
    """The executed plan, as adaptive execution left it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["length_filter", "window_filter", "sft_training_set", "length_stats"])
def test_texts_are_tokenized_once(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("regexp_count(") + plan.count("RegExpCount") + plan.count("regexp_extract_all(") == 1 or plan.count("[\\w]++") == 1


def test_percentile_filter_tokenizes_once_a_pass(spark):
    plan = plan_of(spark, "length_percentile_filter")
    passes = plan.count("FileScan")
    assert plan.count("[\\w]++") == passes == 2  # the threshold, and the rows


def test_source_filters_go_below_the_length(spark):
    from tessera.operators import lengths as L
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    df = L.length_filter(L.with_length(docs.select("doc_id", "lang", "source", "text"), "text", "N").where("lang = 'de'"), "N").select("doc_id", "N")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in plan and "source" not in plan.split("ReadSchema")[1]
    nothing = spark.createDataFrame([(1, None), (2, "a b")], "doc_id int, text string")
    assert [tuple(r) for r in L.with_length(nothing, "text", "text").collect()] == [(1, None), (2, 2)]


def test_pair_summary_shuffles_no_text(spark):
    plan = plan_of(spark, "pair_summary")
    lines = plan.splitlines()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert below and all("response" not in x.split("output")[0].split("functions=")[0] for x in below)
    for line in lines:
        if "HashAggregate(keys=[problem_id" in line:
            assert "first(CASE WHEN (model" not in line or "response" not in line.replace("Contains(response", "")


def test_matrix_of_models_moves_bitsets_only(spark):
    plan = plan_of(spark, "pair_matrix")
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("bit_or") >= 2


def test_group_advantage_reads_its_input_once(spark):
    plan = final_plan(E.queries()["group_advantage"](spark, SF01))
    assert plan.count("FileScan") == 3 and plan.count("ReusedExchange") == 2  # lineitem, documents, conversations


def test_lookup_groups_by_digest(spark):
    plan = plan_of(spark, "ground_truth_lookup")
    keyed = [x for x in plan.splitlines() if "Aggregate(keys=[__t_h#" in x]
    assert keyed and not any("exercise_text" in x or "__t_t" in x or "__t_v" in x for x in keyed)
    assert not any(("keys=[text" in x or "keys=[exercise_text" in x) for x in plan.splitlines())


def jobs_while(spark, build):
    tracker, group = spark.sparkContext.statusTracker(), f"building-{build.__name__}"
    spark.sparkContext.setJobGroup(group, "build only")
    try:
        built = build()
    finally:
        jobs = tracker.getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return built, len(jobs)


def test_building_starts_no_job(spark):
    from tessera.operators import compare as C, evaluate as V, judge as J, rewards as R
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "n_chars", "text", "lang")

    def numbers():
        return C.number_rows(docs, ["n_chars", "doc_id"])

    def advantage():
        return R.group_advantage(docs, "lang", "n_chars")

    def pairing():
        return V.pair_outputs_truths(docs.select("doc_id", "text"), docs.select("doc_id", "n_chars"), "doc_id")

    def lookup():
        return J.late_ground_truth(docs.withColumnRenamed("text", "problem"), docs.selectExpr("text as exercise_text", "lang as solution_text", "doc_id as line_no"))

    for build in (numbers, advantage, pairing, lookup):
        built, jobs = jobs_while(spark, build)
        assert jobs == 0 and built.count() == docs.count()
