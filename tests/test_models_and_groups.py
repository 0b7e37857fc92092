"""Any number of models, late lookups, numbering, grouped user rewards, line numbers."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import compare as C
from tessera.operators import judge as J
from tessera.operators import keys as K
from tessera.operators import rewards as R
from tessera.sources import io as IO


@pytest.mark.parametrize("n", [2, 3, 64, 130])
def test_pair_matrix_against_pairs(spark, n):
    """More models than a word has bits, missing rows, null checks, a model that is not asked for."""
    r = random.Random(n)
    models = [f"m{k}" for k in range(n)]
    rows = [(p, m, r.choice([True, False, None])) for p in range(12) for m in [*models, "other"] if r.random() < 0.8]
    df = spark.createDataFrame(rows, "problem_id long, model string, ok boolean").repartition(3)
    some = models if n < 100 else models[:3] + models[58:64] + models[-3:]
    got = {(x.base, x.tuned): x for x in C.pair_matrix(df, models, "ok").where(F.col("base").isin(some) & F.col("tuned").isin(some)).collect()}
    passed = {(p, m): bool(ok) for p, m, ok in rows}
    for a, b in itertools.combinations(some, 2):
        both = [(passed[p, a], passed[p, b]) for p in range(12) if (p, a) in passed and (p, b) in passed]
        x = got[a, b]
        assert (x.both, x.base_only, x.tuned_only, x.neither) == (both.count((True, True)), both.count((True, False)), both.count((False, True)), both.count((False, False)))
        assert x.num_problems == len(both) and x.improvement == x.tuned_correct - x.base_correct == x.tuned_only - x.base_only
        assert x.finding == ("improved" if x.improvement > 0 else "equal" if x.improvement == 0 else "decreased")
    assert len(got) == len(some) * (len(some) - 1) // 2


def test_pair_matrix_edges(spark):
    none = spark.createDataFrame([], "problem_id long, model string, ok boolean")
    row = C.pair_matrix(none, ["a", "b"], "ok").first()
    assert row.num_problems == 0 and row.base_accuracy is None and row.finding == "equal"
    twice = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", True)], "problem_id long, model string, ok boolean")
    with pytest.raises(Exception, match="a key occurs 2 times"):
        C.pair_matrix(twice, ["a", "b"], "ok").collect()
    assert C.model_bits(twice, ["a", "b"], "ok", check_unique=False).first().passed0 == 3
    for bad in ([], ["a"], ["a", "a"]):
        with pytest.raises(ValueError):
            C.pair_matrix(twice, bad, "ok")
    two = C.pair_outcomes(twice.dropDuplicates(), ["b", "a"], "ok").collect()
    assert [(x.base, x.tuned, x.outcome) for x in two] == [("b", "a", "both")]


def test_pairs_keep_nulls_and_structs(spark):
    schema = "problem_id long, model string, response string, check struct<a:boolean,b:string>, other map<string,int>"
    rows = [(1, "base", None, None, {"x": 1}), (1, "tuned", "t", (True, None), None)]
    p = C.pair_models(spark.createDataFrame(rows, schema), value_cols=("response", "check")).first()
    assert p.base_response is None and p.base_check is None and p.sft_check.a is True and p.sft_check.b is None and p.other == {"x": 1}


def ground_truths(spark, results, exercises, **options):
    ex = spark.createDataFrame(exercises, "exercise_text string, solution_text string, line_no long").repartition(3)
    res = spark.createDataFrame(results, "problem_id long, problem string").repartition(2)
    return {r.problem_id: r.ground_truth for r in J.late_ground_truth(res, ex, **options).collect()}


def test_late_lookup_is_last_wins(spark):
    r = random.Random(1)
    texts = ["", " ", "a", "b", None, "long " * 5000, *(f"t{k}" for k in range(50))]
    exercises = [(r.choice(texts), f"s{k}", k) for k in range(200)]
    results = [(k, r.choice([*texts, "unknown"])) for k in range(300)]
    last = {t: s for t, s, _ in exercises}
    got = ground_truths(spark, results, exercises)
    assert got == {k: J.GT_NOT_FOUND if t is None else last.get(t, J.GT_NOT_FOUND) for k, t in results}
    assert ground_truths(spark, results, []) == {k: J.GT_NOT_FOUND for k, _ in results} and ground_truths(spark, [], exercises) == {}


def test_texts_with_one_digest_are_never_paired(spark):
    def weak(text):
        return (F.length(text).cast("long"),)

    exercises = [("aa", "s1", 1), ("bbb", "s2", 2)]
    assert ground_truths(spark, [(1, "aa"), (2, "c")], exercises, digest=weak) == {1: "s1", 2: J.GT_NOT_FOUND}
    with pytest.raises(Exception, match="two texts share a digest"):
        ground_truths(spark, [(1, "xx")], exercises, digest=weak)


def test_membership_map_has_no_false_misses(spark):
    some = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = K.membership_map(some.unionAll(spark.createDataFrame([(None,)], "h long")))
    other = spark.range(5000, 105000).select(F.xxhash64("id").alias("h"))
    assert some.where(K.may_hold(bits, F.col("h"))).count() == 5000
    assert other.where(K.may_hold(bits, F.col("h"))).count() < 2000
    assert spark.createDataFrame([(None,)], "h long").where(K.may_hold(bits, F.col("h"))).count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 7, 64])
def test_numbering_of_skewed_and_textual_keys(spark, partitions):
    r = random.Random(2)
    rows = [(r.choice(["same", "same", f"k{r.randrange(50)}", None]), k, "x" * (k % 50)) for k in range(600)]
    df = spark.createDataFrame(rows, "name string, id long, payload string").repartition(5)
    got = C.number_rows(df, ["name", "id"], "n", partitions=partitions).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert [(x.name, x.id, x.payload) for x in sorted(got, key=lambda x: x.n)] == want and [x.n for x in sorted(got, key=lambda x: x.n)] == list(range(1, 601))
    assert C.number_rows(df.limit(0), ["name", "id"]).collect() == []


def test_grouped_user_rewards(spark):
    """A prompt's completions come together, hot prompts in parts; prompts, answers and further columns arrive as lists."""
    def together(prompts, completions, answer, tag, **kwargs):
        assert not kwargs and len({p[0]["content"] for p in prompts}) == 1 and all(c[0]["role"] == "assistant" for c in completions)
        return [len(completions) * 1000.0 + t + (a is None) for t, a in zip(tag, answer)]

    rows = [(k % 20 if k < 100 else None if k < 110 else 77, k, f"c{k}", None if k % 3 else str(k), k % 7, [1.5, float(k)]) for k in range(400)]
    df = spark.createDataFrame(rows, "prompt_id long, gen_id long, completion string, answer string, tag int, more array<double>").repartition(4)
    df = df.withColumn("prompt", F.coalesce(F.col("prompt_id").cast("string"), F.lit("none")))
    out = R.user_rewards_by_group(df, {"r": together}, "prompt_id", prompt="prompt", extra=["tag"], group_rows=50)
    got = out.collect()
    assert out.columns == [*df.columns, "r"] and sorted(x.gen_id for x in got) == list(range(400))
    for x in got:
        size, rest = divmod(x.r, 1000)
        assert rest == x.tag + (x.answer is None) and x.more == [1.5, float(x.gen_id)]
        assert size == (5 if x.prompt_id in range(20) else 10) if x.prompt_id != 77 else 1 <= size < 120
    scored = R.score(df, rewards=["format_approx"], user_rewards={"u": together}, prompt="prompt", group="prompt_id", extra=["tag"])
    assert all(x.total == x.reward_format_approx + x.reward_u for x in scored.collect())
    with pytest.raises(ValueError):
        R.user_rewards_by_group(out, {"r": together})
    with pytest.raises(Exception, match="returned 1 values"):
        R.user_rewards_by_group(df, {"r": lambda **k: [1.0]}, "prompt_id").collect()
    assert R.user_rewards_by_group(df.limit(0), {"r": together}, "prompt_id", prompt="prompt", extra=["tag"]).collect() == []


def test_many_prompts_in_a_batch(spark):
    """Prompts share Arrow batches and are cut at their first rows, also where a prompt goes on in the next batch; keys of several
    columns, null and not a number; the rows stay where they are for the prompts that are split."""
    def together(prompts, completions, answer, tag, **kwargs):
        assert len({p[0]["content"] for p in prompts}) == 1
        return [len(tag) * 1000.0 + min(tag)] * len(tag)

    sizes = [k % 9 + (40 if k % 50 == 7 else 0) for k in range(200)]
    rows = [(None if p == 3 else f"p{p}", float("nan") if p == 4 else float(p // 2), f"p{p}", p * 100 + k, f"c{k}", None if k % 2 else "a", {"k": p}) for p, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "name string, half double, prompt string, tag long, completion string, answer string, more map<string,long>").repartition(5)
    confs = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        out = R.user_rewards_by_group(df, {"r": together, "s": together}, ["name", "half"], prompt="prompt", extra=["tag"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "SortMergeJoin" not in plan
    assert sorted((x.tag, x.completion, x.more["k"]) for x in got) == sorted((x[3], x[4], x[6]["k"]) for x in rows)
    assert all(x.r == x.s == sizes[x.tag // 100] * 1000 + x.tag // 100 * 100 for x in got)


def test_user_rewards_get_kwargs_and_message_lists(spark):
    def fn(prompts, completions, answer, weight, **kwargs):
        return [None if w is None else w * len(c[0]["content"]) + len(p) for p, c, w in zip(prompts, completions, weight)]

    msg = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("system", "s"), ("user", "u")], "abc", "1", 2.0), ([("user", "u")], "", None, None)], f"prompt {msg}, completion string, answer string, weight double")
    got = R.score(df, rewards=["format_exact"], user_rewards={"f": fn}, prompt="prompt", extra=["weight"], total=None).collect()
    assert [x.reward_f for x in got] == [8.0, None]


def test_group_advantage_with_null_keys_and_rewards(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, None), (1, 2.0), (2, 5.0)], "prompt_id long, total double").repartition(3)
    got = sorted(((x.prompt_id is None, x.prompt_id or 0, x.total or 0, x.advantage) for x in R.group_advantage(df).collect()), key=lambda x: x[:3])
    assert got == [(False, 1, 0, None), (False, 1, 2.0, 0.0), (False, 2, 5.0, 0.0), (True, 0, 1.0, -1.0), (True, 0, 3.0, 1.0)]


def test_line_numbers_over_splits_and_blank_lines(spark, tmp_path):
    lines = []
    for k in range(3000):
        lines.append("" if k % 10 == 3 else '{"exercise_number": "%d", "exercise_text": "t%d"}' % (k + 1, k))
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines if name == "a" else lines[:50]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = IO.read_exercise_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2700 + 45 and all(x.line_no == int(x.exercise_number) for x in got)


def test_exercise_files_in_parts(spark, tmp_path):
    """No task writes or reads a whole file of exercises, and line numbers run through its parts."""
    from pathlib import Path

    from tessera.plans.catalog import exercise_lines
    from tessera.session import checkpoint_dir

    ids = [*range(-7, 3000, 3), 3001, 3001, None, None]
    random.Random(3).shuffle(ids)
    rows = [(i, f"t{i}\nx", "s", "en") for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    known = set(folder.glob("tessera-exercises-*"))
    confs = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "3000",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        out = exercise_lines(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    (new,) = set(folder.glob("tessera-exercises-*")) - known
    lines = [len(f.read_text().splitlines()) for f in new.glob("part=*/*.json")]
    assert sum(lines) == len(ids) and max(lines) < len(ids) / 8
    assert "SortMergeJoin" not in plan
    want = []
    for p in (-3, -2, -1, 0, 1, 2, 3, None):
        own = sorted(i for i in ids if i is not None and math.fmod(i, 4) == p) if p is not None else [None, None]
        want += [(f"ex.{i}" if i is not None else None, n) for n, i in enumerate(own, 1)]
    assert sorted(map(str, want)) == sorted(str((x.exercise_number, x.line_no)) for x in got)
