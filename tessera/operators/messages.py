"""Chat messages and chat-template rendering.

A conversation is ``ARRAY<STRUCT<role STRING, content STRING>>``. The
template rule (P7):

* first message is ``system`` -> its content + eos, else default prompt + eos;
* then ``user`` -> content, ``assistant`` -> content + eos, any other role
  (including a later ``system``) -> nothing;
* optional trailing reasoning-start tag (generation prompt).

Because a ``system`` turn never renders in the loop, rendering equals
``head(first message) + concat(fragment(m) for m in messages) + tail``;
that form needs no positional special case and lets turn tables render in
two partial stages (see :func:`render_turns`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tags import DEFAULT_TAGS, Tags
from tessera.functions.text import col, remove_think_markers, strip

MSG_TYPE = "array<struct<role:string,content:string>>"


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), col(content).alias("content"))


def fragment(role: Column, content: Column, eos: str) -> Column:
    """Loop-body rendering of one message."""
    return (F.when(role == "user", content)
             .when(role == "assistant", F.concat(content, F.lit(eos)))
             .otherwise(F.lit("")))


def head(first_role: Column, first_content: Column, tags: Tags) -> Column:
    return F.when(first_role == "system", F.concat(first_content, F.lit(tags.eos))) \
            .otherwise(F.lit(tags.system_prompt + tags.eos))


def render(messages, tags: Tags = DEFAULT_TAGS, add_generation_prompt: bool = False) -> Column:
    """Render a message array to the training / prompt text."""
    ms = col(messages)
    first = F.get(ms, 0)
    body = F.array_join(F.transform(ms, lambda m: fragment(m["role"], m["content"], tags.eos)), "")
    parts = [head(first["role"], first["content"], tags), F.coalesce(body, F.lit(""))]
    if add_generation_prompt:
        parts.append(F.lit(tags.reasoning_start))
    return F.concat(*parts)


def render_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                 role: str = "role", content: str = "text", tags: Tags = DEFAULT_TAGS,
                 add_generation_prompt: bool = False, chunk_turns: int = 512,
                 out: str = "text") -> DataFrame:
    """P7 over a turn table ``(key, order, role, content)`` -> ``(key, out)``.

    Two partial stages so no conversation is gathered row-by-row into one
    task: stage 1 renders chunks of ``chunk_turns`` consecutive turns per
    (conversation, chunk); stage 2 joins the few chunk strings in order.
    Each stage carries the earliest turn's (role, content) for the head.
    """
    t = turns.select(
        F.col(key).alias("_k"), F.col(order).alias("_o"),
        F.floor(F.col(order) / F.lit(chunk_turns)).alias("_c"),
        F.struct(F.col(role).alias("role"), F.col(content).alias("content")).alias("_m"),
        fragment(F.col(role), F.col(content), tags.eos).alias("_f"))
    s1 = (t.groupBy("_k", "_c")
           .agg(F.min_by("_m", "_o").alias("_first"), F.min("_o").alias("_fo"),
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_f"))),
                                         lambda x: x["_f"]), "").alias("_p")))
    s2 = (s1.groupBy("_k")
            .agg(F.min_by("_first", "_fo").alias("_first"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_p"))),
                                          lambda x: x["_p"]), "").alias("_body")))
    parts = [head(F.col("_first.role"), F.col("_first.content"), tags), F.col("_body")]
    if add_generation_prompt:
        parts.append(F.lit(tags.reasoning_start))
    return s2.select(F.col("_k").alias(key), F.concat(*parts).alias(out))


def sft_messages(df: DataFrame, tags: Tags = DEFAULT_TAGS, problem: str = "problem",
                 answer: str = "expected_answer", solution: str = "generated_solution",
                 out: str = "Messages") -> DataFrame:
    """``[system, user, assistant]``; assistant = tags around cleaned thoughts and answer."""
    thoughts = strip(remove_think_markers(solution))
    assistant = F.concat(F.lit(tags.reasoning_start), thoughts, F.lit(tags.reasoning_end),
                         F.lit(tags.solution_start), col(answer), F.lit(tags.solution_end))
    return df.withColumn(out, F.array(message("system", F.lit(tags.system_prompt)),
                                      message("user", col(problem)), message("assistant", assistant)))


def proof_messages(df: DataFrame, tags: Tags = DEFAULT_TAGS, problem: str = "exercise_text",
                   solution: str = "solution_text", out: str = "Messages",
                   proven: str = "Proven.") -> DataFrame:
    """Whole solution is the reasoning; solution body is the literal ``Proven.``."""
    assistant = F.concat(F.lit(tags.reasoning_start), col(solution), F.lit(tags.reasoning_end),
                         F.lit(tags.solution_start + proven + tags.solution_end))
    return df.withColumn(out, F.array(message("system", F.lit(tags.system_prompt)),
                                      message("user", col(problem)), message("assistant", assistant)))


def rl_messages(df: DataFrame, system_prompt: str | None, prompt: str = "prompt",
                out: str | None = None) -> DataFrame:
    """P5: prompt string -> ``[system, user]`` when a system prompt is given.

    Without a system prompt the column stays a string (the reference's
    second output schema); pass ``out`` to keep the original column.
    """
    target = out or prompt
    if system_prompt is None:
        return df if out is None else df.withColumn(out, col(prompt))
    return df.withColumn(target, F.array(message("system", F.lit(system_prompt)),
                                         message("user", col(prompt))))


def generation_prompt(problem, tags: Tags = DEFAULT_TAGS) -> Column:
    """``[system, user]`` rendered with the generation prompt."""
    ms = F.array(message("system", F.lit(tags.system_prompt)), message("user", col(problem)))
    return render(ms, tags, add_generation_prompt=True)


def message_prefix(messages, n: int = 2) -> Column:
    """``Messages[:n]``."""
    return F.slice(col(messages), 1, n)


def first_content(messages) -> Column:
    """``completion[0]['content']`` (null when empty)."""
    return F.get(col(messages), 0)["content"]


def rename_solution_to_answer(df: DataFrame) -> DataFrame:
    """Rename ``solution`` -> ``answer`` only if ``answer`` is absent."""
    if "solution" in df.columns and "answer" not in df.columns:
        return df.withColumnRenamed("solution", "answer")
    return df


def require_columns(df: DataFrame, cols, what: str = "input") -> DataFrame:
    """P10: fail on the driver, before any job, when columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required column(s): {', '.join(missing)}")
    return df
