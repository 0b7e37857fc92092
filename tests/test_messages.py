"""P3-P10, P7 rendering on arrays and turn tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.tags import DEFAULT_TAGS as TG
from tessera.operators import messages as M

EOS, SYS = TG.eos, TG.system_prompt


def py_render(msgs, gen=False):
    if msgs and msgs[0][0] == "system":
        out, rest = msgs[0][1] + EOS, msgs[1:]
    else:
        out, rest = SYS + EOS, msgs
    for role, content in rest:
        if role == "user":
            out += content
        elif role == "assistant":
            out += content + EOS
    return out + (TG.reasoning_start if gen else "")


CASES = [
    [("system", "S"), ("user", "u1"), ("assistant", "a1")],
    [("user", "u1"), ("assistant", "a1"), ("user", "u2")],
    [("user", "u"), ("system", "later"), ("assistant", "a")],
    [],
    [("tool", "t"), ("user", "u")],
]


def test_render_arrays(spark):
    rows = [(i, [{"role": r, "content": c} for r, c in m]) for i, m in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"id int, ms {M.MSG_TYPE}")
    out = df.select("id", M.render("ms").alias("t"), M.render("ms", add_generation_prompt=True).alias("g"))
    for r in out.collect():
        assert r.t == py_render(CASES[r.id]) and r.g == py_render(CASES[r.id], True)


@pytest.mark.parametrize("chunk", [1, 2, 512])
def test_render_turns_matches_arrays(spark, chunk):
    turns = [(i, t, r, c) for i, m in enumerate(CASES) for t, (r, c) in enumerate(m)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r.text for r in M.render_turns(df, chunk_turns=chunk).collect()}
    for i, m in enumerate(CASES):
        if m:
            assert got[i] == py_render(m)


def test_render_turns_long_conversation(spark):
    msgs = [("system", "S")] + [("user" if k % 2 else "assistant", f"m{k}") for k in range(1, 2000)]
    df = spark.createDataFrame([(7, t, r, c) for t, (r, c) in enumerate(msgs)],
                               "conv_id long, turn long, role string, text string").repartition(4)
    assert M.render_turns(df, chunk_turns=64).first().text == py_render(msgs)


def test_sft_and_proof_messages(spark):
    df = spark.createDataFrame([("p", "42", "<think>\n  thoughts </think>")],
                               "problem string, expected_answer string, generated_solution string")
    m = M.sft_messages(df).first().Messages
    assert [x.role for x in m] == ["system", "user", "assistant"]
    assert m[2].content == TG.reasoning_start + "thoughts" + TG.reasoning_end + TG.solution_start + "42" + TG.solution_end
    ex = spark.createDataFrame([("e", "proof")], "exercise_text string, solution_text string")
    pm = M.proof_messages(ex).first().Messages
    assert pm[2].content.endswith(TG.solution_start + "Proven." + TG.solution_end)


def test_rl_messages_modes_and_rename(spark):
    df = spark.createDataFrame([("q", "s")], "prompt string, solution string")
    assert dict(M.rl_messages(df, None).dtypes)["prompt"] == "string"
    assert M.rl_messages(df, SYS).first().prompt[0].role == "system"
    assert "answer" in M.rename_solution_to_answer(df).columns
    both = df.withColumn("answer", F.lit("a"))
    assert M.rename_solution_to_answer(both).columns == both.columns
    with pytest.raises(ValueError):
        M.require_columns(df, ["prompt", "missing"])


def test_message_prefix(spark):
    df = spark.createDataFrame([([{"role": "system", "content": "S"}, {"role": "user", "content": "u"},
                                  {"role": "assistant", "content": "a"}],)], f"ms {M.MSG_TYPE}")
    r = df.select(M.render(M.message_prefix("ms"), add_generation_prompt=True).alias("t")).first()
    assert r.t == "S" + EOS + "u" + TG.reasoning_start
