"""R1-R10, A8, A9, W2, W3, U1."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rewards as R
import pyrules as P

W = "<start_working_out>w<end_working_out>"


def golden_rows():
    # (completion, answer, exact, approx, answer_score, numbers)  -- FIXTURES §4
    return [
        (W + "<SOLUTION>42</SOLUTION>", "42", 3.0, 1.5, 5.0, 4.0),
        ("w<end_working_out><SOLUTION>42</SOLUTION>", "42", 0.0, 1.5, 5.0, 4.0),
        ("no formatting here", "42", 0.0, -3.0, -2.0, -1.5),
        (W + "<SOLUTION>4 2</SOLUTION>", "42", 3.0, 1.5, 3.5, -2.0),
        (W + "<SOLUTION>44.1</SOLUTION>", "42", 3.0, 1.5, 2.0, 2.5),
        (W + "<SOLUTION>48.3</SOLUTION>", "42", 3.0, 1.5, 1.5, 1.5),
        (W + "<SOLUTION>84</SOLUTION>", "42", 3.0, 1.5, -2.5, -2.0),
        (W + "<SOLUTION>forty</SOLUTION>", "42", 3.0, 1.5, -2.5, -1.5),
        (W + "<SOLUTION>0.0</SOLUTION>", "0", 3.0, 1.5, 5.0, 4.0),
        (W + "<SOLUTION>1</SOLUTION>", "0", 3.0, 1.5, -2.5, -2.0),
    ]


def test_golden_package_rewards(spark):
    df = spark.createDataFrame(golden_rows(), "completion string, answer string, e1 double, e2 double, "
                                              "e3 double, e4 double")
    out = R.score(df).collect()
    for r in out:
        got = (r.reward_format_exact, r.reward_format_approx, r.reward_answer, r.reward_numbers)
        assert got == (r.e1, r.e2, r.e3, r.e4), (r.completion, got)
        assert r.total == sum(got)
    assert [r.total for r in out if r.completion == "no formatting here"] == [-6.5]


def test_golden_notebook(spark):
    rows = [(W + "<SOLUTION>1</SOLUTION>", "0", -4.5),
            ("Let me think!<end_working_out><SOLUTION>\n2\n</SOLUTION>", "2", 3.5),
            ("<end_working_out><SOLUTION>  2  </SOLUTION>\n\n", "2", 3.5),
            ("<end_working_out><SOLUTION>2</SOLUTION> trailing", "2", -2.0)]
    df = spark.createDataFrame(rows, "completion string, answer string, want double")
    for r in R.score(df, dialect="notebook").collect():
        assert r.reward_answer == r.want, r
    nums = [("<SOLUTION>  0.34  </SOLUTION>", "0.34", 3.5), ("<SOLUTION>  123,456  </SOLUTION>", "123456", 3.5),
            ("<SOLUTION>.5</SOLUTION>", "0.5", 3.5), ("<SOLUTION>...</SOLUTION>", "1", 0.0),
            ("nothing", "1", -2.5), ("<SOLUTION>7", "x", 0.0)]
    df = spark.createDataFrame(nums, "completion string, answer string, want double")
    for r in R.score(df, rewards=["numbers"], dialect="notebook").collect():
        assert r.reward_numbers == r.want, r


def _random_completions(n, seed):
    rnd = random.Random(seed)
    bodies = ["42", " 42 ", "4 2", "44.1", "48.3", "84", "forty", "0", "0.0", "-3", "1e3", "nan", "inf",
              "1_000", "12,5", "-.5", "The answer is 42", "", "\n7\n", "1.5d"]
    answers = ["42", "0", "-3", "1000", "7", "abc", " 42", "nan", "1e3", "0.5", "12.5"]
    pieces = [P.RS, "w", P.RE_, P.SS, P.SE, "\n", " ", P.EOS]
    out = []
    for _ in range(n):
        k = rnd.random()
        if k < 0.5:
            s = (rnd.choice(["", P.RS]) + "w" + rnd.choice(["", "\n"]) + P.RE_ + rnd.choice(["", "\n"])
                 + P.SS + rnd.choice(bodies) + rnd.choice([P.SE, "", P.SE + P.SE, P.SE + "\n" + P.EOS + " "])
                 + rnd.choice(["", "\n", " x", P.SS + "9" + P.SE]))
        else:
            s = "".join(rnd.choice(pieces + bodies) for _ in range(rnd.randint(0, 10)))
        out.append((s, rnd.choice(answers)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rewards_match_python_rules(spark, seed):
    data = _random_completions(1500, seed)
    df = spark.createDataFrame(data, "completion string, answer string").repartition(5)
    pk = R.score(df).collect()
    for r in pk:
        c, a = r.completion, r.answer
        assert r.reward_format_exact == P.exact_format(c), (c,)
        assert r.reward_format_approx == P.approx_format(c), (c,)
        assert r.reward_answer == P.answer_score(c, a), (c, a)
        assert r.reward_numbers == P.numbers_score(c, a), (c, a)
    nb = R.score(df, dialect="notebook").collect()
    for r in nb:
        c, a = r.completion, r.answer
        assert r.reward_format_exact == P.nb_exact(c), (c,)
        assert r.reward_answer == P.nb_answer(c, a), (c, a)
        assert r.reward_numbers == P.nb_numbers(c, a), (c, a)


def test_column_forms_equal_staged(spark):
    df = spark.createDataFrame(_random_completions(300, 5), "completion string, answer string")
    staged = R.score(df, total=None).collect()
    cols = df.select(R.format_exact("completion").alias("a"), R.format_approx("completion").alias("b"),
                     R.answer_reward("completion", "answer").alias("c"),
                     R.numbers_reward("completion", "answer").alias("d")).collect()
    for s, c in zip(staged, cols):
        assert (s.reward_format_exact, s.reward_format_approx, s.reward_answer, s.reward_numbers) == tuple(c)


def test_null_policy(spark):
    df = spark.createDataFrame([(None, "1"), (W + "<SOLUTION>1</SOLUTION>", None)],
                               "completion string, answer string")
    r = R.score(df, rewards=["answer", "numbers"]).collect()
    assert r[0].reward_answer == -2.0 and r[0].reward_numbers == -1.5
    assert r[1].reward_answer is None and r[1].reward_numbers == -1.5


def test_enabled_rewards_order_and_guard():
    assert R.enabled_rewards() == ["format_exact", "format_approx", "answer", "numbers"]
    assert R.enabled_rewards(True, False, False, True) == ["format_exact", "numbers"]
    with pytest.raises(ValueError):
        R.enabled_rewards(False, False, False, False)


def test_prepend_reasoning_start(spark):
    df = spark.createDataFrame([("w<end_working_out><SOLUTION>1</SOLUTION>", "1")], "completion string, answer string")
    assert R.score(df, rewards=["format_exact"], prepend_reasoning_start=True).first().reward_format_exact == 3.0


def test_group_advantage_and_stats(spark):
    rows = [(1, 1, 1.0), (1, 2, 3.0), (2, 1, 5.0), (2, 2, 5.0), (3, 1, 2.0)]
    df = spark.createDataFrame(rows, "prompt_id long, gen_id int, total double")
    adv = {(r.prompt_id, r.gen_id): r.advantage for r in R.group_advantage(df).collect()}
    assert adv == {(1, 1): -1.0, (1, 2): 1.0, (2, 1): 0.0, (2, 2): 0.0, (3, 1): 0.0}
    st = {r.prompt_id: (r.n, r.reward_mean, r.reward_std) for r in R.group_stats(df).collect()}
    assert st[1] == (2, 2.0, 1.0) and st[2] == (2, 5.0, 0.0)


def test_group_advantage_skewed_prompt(spark):
    # one prompt holds a third of the rows; result must equal the exact formula
    import statistics
    rows = [(0, i, float(i % 7)) for i in range(3000)] + [(p, 0, float(p % 5)) for p in range(1, 6001)]
    df = spark.createDataFrame(rows, "prompt_id long, gen_id int, total double").repartition(8)
    got = R.group_advantage(df).where("prompt_id = 0").collect()
    vals = [float(i % 7) for i in range(3000)]
    m, sd = statistics.fmean(vals), statistics.pstdev(vals)
    for r in got:
        assert abs(r.advantage - (r.total - m) / sd) < 1e-9


def test_user_reward(spark):
    def length_reward(prompts, completions, answer, **kw):
        return [float(len(c[0]["content"])) for c in completions]
    df = spark.createDataFrame([("abc", "1"), ("de", "2")], "completion string, answer string")
    out = R.score(df, rewards=["format_exact"], user_rewards={"len": length_reward}).collect()
    assert [r.reward_len for r in out] == [3.0, 2.0]
    assert [r.total for r in out] == [3.0, 2.0]


def test_debug_sample_is_deterministic(spark):
    df = spark.createDataFrame(_random_completions(500, 3), "completion string, answer string") \
              .withColumn("k", F.monotonically_increasing_id())
    a = sorted(r.k for r in R.debug_sample(df, 5, ["k"]).collect())
    b = sorted(r.k for r in R.debug_sample(df.repartition(3), 5, ["k"]).collect())
    assert a == b and 0 < len(a) < 500


def test_attach_answers_one_to_many(spark):
    comps = spark.createDataFrame([(1, 1, W + "<SOLUTION>5</SOLUTION>"), (1, 2, "x"), (2, 1, W + "<SOLUTION>7</SOLUTION>"),
                                   (3, 1, "orphan")], "prompt_id long, gen_id int, completion string")
    prompts = spark.createDataFrame([(1, "5"), (2, "8")], "prompt_id long, answer string")
    got = {(r.prompt_id, r.gen_id): r.reward_answer for r in
           R.score(R.attach_answers(comps, prompts, strict=False), rewards=["answer"]).collect()}
    assert got == {(1, 1): 5.0, (1, 2): -2.0, (2, 1): 1.5}
    with pytest.raises(Exception, match="no prompt for completion key 3"):
        R.attach_answers(comps, prompts).collect()
    with pytest.raises(Exception, match="prompts: a key occurs 2 times"):
        R.attach_answers(comps.where("prompt_id = 1"), prompts.union(prompts)).collect()


def test_group_advantage_materialized_equals_lazy(spark):
    df = spark.createDataFrame(_random_completions(400, 9), "completion string, answer string") \
              .withColumn("prompt_id", F.pmod(F.xxhash64("completion"), F.lit(37)))
    s = R.score(df)
    a = sorted((r.prompt_id, r.total, r.advantage) for r in R.group_advantage(s).collect())
    b = sorted((r.prompt_id, r.total, r.advantage) for r in R.group_advantage(s, materialize=True).collect())
    assert a == b


def test_group_advantage_eps(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0)], "prompt_id long, gen_id int, total double")
    got = sorted(r.advantage for r in R.group_advantage(df, eps=1.0).collect())
    assert got == [-0.5, 0.5]


def test_message_list_completions(spark):
    from tessera.operators.messages import MSG_TYPE
    df = spark.createDataFrame([([{"role": "assistant", "content": W + "<SOLUTION>42</SOLUTION>"}], "42")],
                               f"completion {MSG_TYPE}, answer string")
    r = R.score(df).first()
    assert r.total == 13.5 and isinstance(r.completion, list)
