"""Completion rewards, two dialects (R1-R10), totals and group statistics.

Input: a table of completions with a text column (``completion``) and an
expected-answer column (``answer``); a message-array completion is adapted
with :func:`tessera.operators.messages.first_content`. Every reward is one
JVM-side ``case when`` over columns, so scoring is a narrow, shuffle-free
projection; only group statistics shuffle (partial aggregate + join).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import ArrayType

from tessera.functions.numeric import py_float
from tessera.functions.tags import DEFAULT_TAGS, Tags
from tessera.functions.text import (_WS, between_tags, col, first_number, occurs_once,
                                    locate_from, nb_number_after, no_spaces, preview, quote_re,
                                    strip)
from tessera.operators.compare import once

# --- fixed values: reward scores ---------------------------------------------
# package check_answer verdicts: NO_MATCH -2.0, EXACT 5.0, WHITESPACE 3.5,
#   EXACT_ZERO 5.0, CLOSE 2.0 (ratio 0.9..1.1), REASONABLE 1.5 (0.8..1.2),
#   WRONG -2.5, NON_NUMERIC -2.5
# package check_numbers: -1.5 no solution / no number / bad expected;
#   expected 0 -> 4.0 / -2.0; |diff| < 1e-6 -> 4.0; 2.5 (0.9..1.1);
#   1.5 (0.8..1.2); else -2.0
# format: exact 3.0 / 0.0; approximate +0.5 / -1.0 per tag occurring once
# notebook check_answer: -2.0 none; 5.0 raw equal; 3.5 equal after strip;
#   2.0 / 1.5 / -2.5 ratio bands; -4.5 non-numeric or expected 0
# notebook check_numbers: -2.5 none; 3.5 equal; -1.5 different; 0 not numeric
VERDICT_SCORES = {
    "NO_MATCH": -2.0, "EXACT": 5.0, "WHITESPACE": 3.5, "EXACT_ZERO": 5.0,
    "CLOSE": 2.0, "REASONABLE": 1.5, "WRONG": -2.5, "NON_NUMERIC": -2.5,
}
# -----------------------------------------------------------------------------

REWARD_ORDER = ("format_exact", "format_approx", "answer", "numbers")


def solution(c, tags: Tags = DEFAULT_TAGS) -> Column:
    """Stripped text between the first solution tags, null if absent."""
    return between_tags(c, tags.solution_start, tags.solution_end)


# ---- package dialect ----------------------------------------------------------

def format_exact(c, tags: Tags = DEFAULT_TAGS, prepend_reasoning_start: bool = False) -> Column:
    """3.0 if ``RS .*? RE SS .*? SE`` occurs anywhere (DOTALL), else 0.0.

    Evaluated with three chained ``locate`` calls (linear, no regex
    backtracking): the earliest start tag gives the earliest possible match.
    """
    c = col(c)
    if prepend_reasoning_start:
        c = F.concat(F.lit(tags.reasoning_start), c)
    mid = tags.reasoning_end + tags.solution_start
    i = F.instr(c, tags.reasoning_start)
    j = locate_from(mid, c, i + F.lit(len(tags.reasoning_start)))
    k = locate_from(tags.solution_end, c, j + F.lit(len(mid)))
    ok = (i > 0) & (j > 0) & (k > 0)
    return F.when(ok, F.lit(3.0)).otherwise(F.lit(0.0))


def format_approx(c, tags: Tags = DEFAULT_TAGS) -> Column:
    """R2 (= R8): +0.5 per tag occurring exactly once, else -1.0 (three tags)."""
    c = col(c)
    total = None
    for t in (tags.reasoning_end, tags.solution_start, tags.solution_end):
        term = F.when(occurs_once(c, t), F.lit(0.5)).otherwise(F.lit(-1.0))
        total = term if total is None else total + term
    return F.coalesce(total, F.lit(-3.0))


def _verdict_expr(s: Column, a: Column, x: Column, e: Column, r: Column) -> Column:
    return (F.when(s.isNull(), F.lit("NO_MATCH"))
             .when(a.isNull(), F.lit(None).cast("string"))
             .when(s == a, F.lit("EXACT"))
             .when(no_spaces(s) == no_spaces(a), F.lit("WHITESPACE"))
             .when(x.isNull() | e.isNull(), F.lit("NON_NUMERIC"))
             .when(e == 0, F.when(x == 0, F.lit("EXACT_ZERO")).otherwise(F.lit("WRONG")))
             .when((r >= 0.9) & (r <= 1.1), F.lit("CLOSE"))
             .when((r >= 0.8) & (r <= 1.2), F.lit("REASONABLE"))
             .otherwise(F.lit("WRONG")))


def answer_verdict(c, answer, tags: Tags = DEFAULT_TAGS, sol: Column | None = None) -> Column:
    """Verdict label of the package ``check_answer``; null if the answer is null.

    Column form (self-contained); :func:`score` stages the shared parts.
    """
    s = solution(c, tags) if sol is None else sol
    a = col(answer)
    x, e = py_float(s), py_float(a)
    return _verdict_expr(s, a, x, e, F.try_divide(x, e))


def verdict_score(verdict: Column) -> Column:
    m = F.create_map(*[x for k, v in VERDICT_SCORES.items() for x in (F.lit(k), F.lit(v))])
    return m[verdict]


def answer_reward(c, answer, tags: Tags = DEFAULT_TAGS, sol: Column | None = None) -> Column:
    """Package ``check_answer`` score (lookup of the R5 verdict)."""
    return verdict_score(answer_verdict(c, answer, tags, sol))


def _numbers_expr(s: Column, num: Column, x: Column, e: Column, r: Column) -> Column:
    return (F.when(s.isNull() | num.isNull() | e.isNull(), F.lit(-1.5))
             .when(e == 0, F.when(x == 0, F.lit(4.0)).otherwise(F.lit(-2.0)))
             .when(F.abs(x - e) < F.lit(1e-6), F.lit(4.0))
             .when((r >= 0.9) & (r <= 1.1), F.lit(2.5))
             .when((r >= 0.8) & (r <= 1.2), F.lit(1.5))
             .otherwise(F.lit(-2.0)))


def numbers_reward(c, answer, tags: Tags = DEFAULT_TAGS, sol: Column | None = None) -> Column:
    """Package ``check_numbers`` on the first number of the solution."""
    s = solution(c, tags) if sol is None else sol
    num = first_number(s)
    x, e = num.try_cast("double"), py_float(answer)
    return _numbers_expr(s, num, x, e, F.try_divide(x, e))


# ---- notebook dialect -----------------------------------------------------------

def nb_format_regex(tags: Tags = DEFAULT_TAGS) -> str:
    """R7 pattern (Java): group 1 is the solution body; ``$`` ends a line at ``\\n`` only."""
    ws = f"[{_WS[1:-1]}]{{0,}}"
    return (f"(?msdU){quote_re(tags.reasoning_end)}.*?{quote_re(tags.solution_start)}(.+?)"
            f"{quote_re(tags.solution_end)}{ws}(?:{quote_re(tags.eos)})?{ws}$")


def nb_body(c, tags: Tags = DEFAULT_TAGS) -> Column:
    """R7 group 1 (unstripped), null when the pattern does not occur."""
    c = col(c)
    p = nb_format_regex(tags)
    # the pattern needs all three tags: three instr calls skip the regex otherwise
    tagged = ((F.instr(c, tags.reasoning_end) > 0) & (F.instr(c, tags.solution_start) > 0)
              & (F.instr(c, tags.solution_end) > 0))
    # group 1 is ``.+?`` (never empty): '' from regexp_extract means no match
    return F.when(tagged, F.nullif(F.regexp_extract(c, p, 1), F.lit("")))


def nb_format_exact(c, tags: Tags = DEFAULT_TAGS, body: Column | None = None) -> Column:
    """3.0 when the notebook format regex matches."""
    b = nb_body(c, tags) if body is None else body
    return F.when(b.isNotNull(), F.lit(3.0)).otherwise(F.lit(0.0))


def _nb_answer_expr(g: Column, a: Column, gs: Column, as_: Column, x: Column, e: Column,
                    r: Column) -> Column:
    return (F.when(g.isNull(), F.lit(-2.0))
             .when(a.isNull(), F.lit(None).cast("double"))
             .when(g == a, F.lit(5.0))
             .when(gs == as_, F.lit(3.5))
             .when(x.isNull() | e.isNull() | (e == 0), F.lit(-4.5))
             .when((r >= 0.9) & (r <= 1.1), F.lit(2.0))
             .when((r >= 0.8) & (r <= 1.2), F.lit(1.5))
             .otherwise(F.lit(-2.5)))


def nb_answer_reward(c, answer, tags: Tags = DEFAULT_TAGS, body: Column | None = None) -> Column:
    """Notebook ``check_answer``; expected 0 joins the -4.5 branch."""
    g = nb_body(c, tags) if body is None else body
    a = col(answer)
    x, e = py_float(g), py_float(a)
    return _nb_answer_expr(g, a, strip(g), strip(a), x, e, F.try_divide(x, e))


def _nb_numbers_expr(g: Column, x: Column, e: Column) -> Column:
    return (F.when(g.isNull(), F.lit(-2.5))
             .when(x.isNull() | e.isNull(), F.lit(0.0))
             .when(x == e, F.lit(3.5))
             .otherwise(F.lit(-1.5)))


def nb_numbers_reward(c, answer, tags: Tags = DEFAULT_TAGS) -> Column:
    """Notebook ``check_numbers``; first ``-?[\\d.,]+`` after the solution tag."""
    g = nb_number_after(c, tags.solution_start)
    return _nb_numbers_expr(g, py_float(F.replace(g, F.lit(","), F.lit(""))), py_float(answer))


# ---- registry, totals (R6, A8, U1) ---------------------------------------------

RewardBuilder = Callable[..., Column]


def reward_builders(dialect: str = "package") -> dict[str, RewardBuilder]:
    """Name -> builder(completion, answer, tags, ctx) per dialect.

    ``ctx`` maps intermediate names to Columns already projected by
    :func:`score` (solution, parsed numbers, ratios), so every reward is a
    flat ``case when`` over column references.
    """
    if dialect == "package":
        return {
            "format_exact": lambda c, a, t, cx: format_exact(c, t, cx.get("prepend", False)),
            "format_approx": lambda c, a, t, cx: format_approx(c, t),
            "answer": lambda c, a, t, cx: verdict_score(
                _verdict_expr(cx["sol"], a, cx["x"], cx["e"], cx["r"])),
            "numbers": lambda c, a, t, cx: _numbers_expr(cx["sol"], cx["num"], cx["nx_pkg"], cx["e"],
                                                         cx["rn"]),
        }
    if dialect == "notebook":
        return {
            "format_exact": lambda c, a, t, cx: nb_format_exact(c, t, cx["body"]),
            "format_approx": lambda c, a, t, cx: format_approx(c, t),
            "answer": lambda c, a, t, cx: _nb_answer_expr(cx["body"], a, cx["bs"], cx["as"], cx["gx"],
                                                          cx["e"], cx["rg"]),
            "numbers": lambda c, a, t, cx: _nb_numbers_expr(cx["nbnum"], cx["nx"], cx["e"]),
        }
    raise ValueError(f"unknown dialect {dialect!r}")


def _stage_intermediates(df: DataFrame, completion: str, answer: str, rewards: Sequence[str],
                         dialect: str, tags: Tags) -> tuple[DataFrame, dict, list[str]]:
    """Project shared intermediates in three narrow stages (each computed once per row)."""
    c, a = F.col(completion), F.col(answer)
    s1, s2, s3 = {}, {}, {}
    need = set(rewards)
    if dialect == "package" and need & {"answer", "numbers"}:
        s1["__t_sol"] = solution(c, tags)
        s2["__t_e"] = py_float(a)
        s2["__t_x"] = py_float(F.col("__t_sol"))
        s2["__t_num"] = first_number(F.col("__t_sol"))
        s3["__t_r"] = F.try_divide(F.col("__t_x"), F.col("__t_e"))
        s3["__t_nxp"] = F.col("__t_num").try_cast("double")
    if dialect == "notebook":
        if need & {"format_exact", "answer"}:
            s1["__t_body"] = nb_body(c, tags)
        if "answer" in need:
            s2["__t_e"] = py_float(a)
            s2["__t_gx"] = py_float(F.col("__t_body"))
            s2["__t_bs"] = strip(F.col("__t_body"))
            s2["__t_as"] = strip(a)
            s3["__t_rg"] = F.try_divide(F.col("__t_gx"), F.col("__t_e"))
        if "numbers" in need:
            s1["__t_nbnum"] = nb_number_after(c, tags.solution_start)
            s2["__t_e"] = py_float(a)
            s2["__t_nx"] = py_float(F.replace(F.col("__t_nbnum"), F.lit(","), F.lit("")))
    for stage in (s1, s2, s3):
        if stage:
            df = df.withColumns(stage)
    names = [*s1, *s2, *s3]
    if "__t_nxp" in s3:
        s3["__t_rn"] = F.try_divide(F.col("__t_nxp"), F.col("__t_e"))
        df = df.withColumn("__t_rn", s3["__t_rn"])
        names.append("__t_rn")
    alias = {"__t_sol": "sol", "__t_e": "e", "__t_x": "x", "__t_num": "num", "__t_r": "r", "__t_nxp": "nx_pkg",
             "__t_rn": "rn", "__t_body": "body", "__t_gx": "gx", "__t_bs": "bs", "__t_as": "as", "__t_rg": "rg",
             "__t_nbnum": "nbnum", "__t_nx": "nx"}
    ctx = {alias[n]: F.col(n) for n in names}
    return df, ctx, names


def enabled_rewards(use_format_exact: bool = True, use_format_approximate: bool = True,
                    use_answer_check: bool = True, use_number_check: bool = True) -> list[str]:
    """Enabled rewards in fixed order; at least one is required."""
    flags = (use_format_exact, use_format_approximate, use_answer_check, use_number_check)
    names = [n for n, on in zip(REWARD_ORDER, flags) if on]
    if not names:
        raise ValueError("at least one reward function must be enabled")
    return names


def score(df: DataFrame, completion: str = "completion", answer: str = "answer",
          rewards: Sequence[str] = REWARD_ORDER, dialect: str = "package",
          tags: Tags = DEFAULT_TAGS, total: str | None = "total",
          prepend_reasoning_start: bool = False, prefix: str = "reward_",
          user_rewards: dict[str, Callable] | None = None, prompt: str | None = None,
          group: str | Sequence[str] | None = None, extra: Sequence[str] = (),
          solution_out: str | None = None) -> DataFrame:
    """Add one column per enabled reward and their row-wise sum.

    ``user_rewards`` get the prompts (column ``prompt``) and the ``extra`` columns as keyword arguments; with
    ``group`` a prompt's completions come in one call (:func:`user_rewards_by_group`), else a batch does.
    ``solution_out`` keeps the extracted solution as a column.

    ``completion`` may be text or the reference's message list (the first
    message's content is scored).

    Shared intermediates (extracted solution, parsed numbers, ratios) are
    projected once in narrow stages; every reward is then a flat ``case when``
    over column references. All stages stay inside one whole-stage-codegen
    span with no shuffle.
    """
    builders = reward_builders(dialect)
    unknown = [r for r in rewards if r not in builders]
    if unknown:
        raise ValueError(f"unknown reward(s): {unknown}")
    adapted = []
    if isinstance(df.schema[completion].dataType, ArrayType):
        # message-list completions: score completion[0]["content"]
        df = df.withColumn("__t_text", F.get(F.col(completion), 0)["content"])
        completion, adapted = "__t_text", ["__t_text"]
    staged, ctx, tmp = _stage_intermediates(df, completion, answer, rewards, dialect, tags)
    tmp = tmp + adapted
    ctx["prepend"] = prepend_reasoning_start
    out_cols = {}
    for r in rewards:
        out_cols[prefix + r] = builders[r](F.col(completion), F.col(answer), tags, ctx)
    own = {prefix + name: fn for name, fn in (user_rewards or {}).items()}
    if not group:
        out_cols |= {name: user_reward_column(fn, completion, answer, prompt, extra) for name, fn in own.items()}
    if solution_out:
        out_cols[solution_out] = ctx["sol"] if "sol" in ctx else solution(completion, tags)
    res = staged.withColumns(out_cols)
    if group and own:
        res = user_rewards_by_group(res, own, group, completion, answer, prompt, extra)
    if total:
        names = [n for n in (*out_cols, *own) if n != solution_out]
        names = list(dict.fromkeys(names))
        tot = F.col(names[0])
        for n in names[1:]:
            tot = tot + F.col(n)
        res = res.withColumn(total, tot)
    return res.drop(*tmp)


def _as_messages(values: Sequence, role: str) -> list[list[dict]]:
    """Texts as one message of ``role``; message lists as they are."""
    return [[{"role": m["role"], "content": m["content"]} for m in v] if isinstance(v, (list, tuple)) or hasattr(v, "dtype")
            else [{"role": role, "content": v}] for v in values]


def _call_reward(fn: Callable, prompts: Sequence, completions: Sequence, answers: Sequence, kwargs: dict) -> list:
    values = fn(prompts=_as_messages(prompts, "user"), completions=_as_messages(completions, "assistant"), answer=list(answers), **kwargs)
    if len(values) != len(answers):
        raise ValueError(f"a reward function returned {len(values)} values for {len(answers)} completions")
    return [None if v is None else float(v) for v in values]


def user_reward_column(fn: Callable, completion: str = "completion", answer: str = "answer",
                       prompt: str | None = None, extra: Sequence[str] = ()) -> Column:
    """Wrap ``fn(prompts, completions, answer, **kwargs) -> list[float]`` as an Arrow UDF.

    Prompts and completions are handed over in the reference's message-list shape
    (``[[{"role": "assistant", "content": text}], ...]``), the ``extra`` columns as lists under their names, one Arrow batch
    per call.
    """
    @F.pandas_udf("double")
    def _udf(*columns: pd.Series) -> pd.Series:
        comp, ans, pr, *more = (c.astype(object).where(c.notna(), None).tolist() for c in columns)
        return pd.Series(_call_reward(fn, pr, comp, ans, dict(zip(extra, more))), dtype="float64")

    pcol = F.col(prompt) if prompt else F.lit(None).cast("string")
    return _udf(F.col(completion), F.col(answer), pcol, *[F.col(c) for c in extra])


#: completions of one prompt that one call gets at most; a prompt with more of them is split
GROUP_ROWS = 4096


def _plain(values: pa.ChunkedArray) -> list:
    """``to_pylist``, by way of numpy for the types that it turns into the same objects."""
    kind = values.type
    same = pa.types.is_integer(kind) or pa.types.is_float64(kind) or pa.types.is_boolean(kind)
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or same and not values.null_count:
        return values.to_numpy(zero_copy_only=False).tolist()
    return values.to_pylist()


def _changes(values: pa.Array) -> pa.Array:
    """For each row but the first: whether its value is in another group than the one before; null is with null, NaN with NaN."""
    a, b = values.slice(0, max(len(values) - 1, 0)), values.slice(1)
    if pa.types.is_nested(values.type):
        return pa.array([repr(x) != repr(y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    if pa.types.is_floating(values.type):
        same = pc.and_(same, pc.equal(pc.is_null(a), pc.is_null(b)))
    return pc.invert(same)


def user_rewards_by_group(df: DataFrame, rewards: dict[str, Callable], group: str | Sequence[str] = "prompt_id",
                          completion: str = "completion", answer: str = "answer", prompt: str | None = None,
                          extra: Sequence[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """User rewards whose calls get a prompt's completions together, as a trainer hands them over.

    A prompt with more than ``group_rows`` completions is split by a hash of the row into as many calls as it needs,
    so no group outgrows a task. Its size comes from one count per prompt (map-side combined); the prompts that are split, at most one
    in ``group_rows`` rows, are broadcast to the rows. These are sorted by key, so that a task gets many prompts in each Arrow batch and cuts them
    where the key changes.
    """
    keys = [group] if isinstance(group, str) else list(group)
    by = [*(f"_k{i}" for i in range(len(keys))), "_salt"]
    clash = [n for n in (*rewards, *by, "_n") if n in df.columns]
    if clash:
        raise ValueError(f"column(s) exist already: {clash}")
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows)
    renamed = large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    calls = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(group_rows))
    row = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])
    salted = df.join(F.broadcast(renamed), same, "left").withColumn("_salt", F.pmod(row, calls)).select(*df.columns, "_salt")
    dealt = salted.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)}).repartition(*by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in rewards]])

    def cuts(rows: pa.Table) -> list[int]:
        """Places of the rows that belong to another call than the row before."""
        other = _changes(rows.column(by[0]).combine_chunks())
        for c in by[1:]:
            other = pc.or_(other, _changes(rows.column(c).combine_chunks()))
        return [i + 1 for i in pc.indices_nonzero(other).to_pylist()]

    def scored(table: pa.Table) -> list[pa.RecordBatch]:
        """Rows of whole calls with their rewards."""
        begins = [0, *cuts(table)]
        lists = {c: _plain(table.column(c)) for c in {completion, answer, *extra, *([prompt] if prompt else [])}}
        lists[None] = [None] * table.num_rows
        out = table.drop_columns(by)
        for name, fn in rewards.items():
            values: list = []
            for a, b in zip(begins, [*begins[1:], table.num_rows]):
                values += _call_reward(fn, lists[prompt][a:b], lists[completion][a:b], lists[answer][a:b], {c: lists[c][a:b] for c in extra})
            out = out.append_column(name, pa.array(values, pa.float64()))
        return out.to_batches()

    def call(batches):
        held: list[pa.RecordBatch] = []  # the last call's rows so far, the next batch may have more of them
        for batch in batches:
            if not batch.num_rows:
                continue
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            begins = [i - len(before) for i in cuts(pa.Table.from_batches([*before, batch]))]
            if begins:
                yield from scored(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]))
                held, batch = [], batch.slice(begins[-1])
            held.append(batch)
        if held:
            yield from scored(pa.Table.from_batches(held))

    return dealt.mapInArrow(call, schema)


# ---- pairing completions with prompts (J3) ---------------------------------------

def attach_answers(completions: DataFrame, prompts: DataFrame, key: str = "prompt_id",
                   answer: str = "answer", strict: bool = True) -> DataFrame:
    """Give each completion its prompt's expected answer (N:1).

    A prompt key that occurs twice raises when the query runs, so no row is multiplied. A completion
    without a prompt raises too; with ``strict=False`` it is left out. Spark/AQE picks broadcast when the prompts are small at run time, otherwise
    a sort-merge join whose skewed partitions AQE splits.
    """
    one = prompts.groupBy(key).agg(F.first(answer).alias(answer), F.count(F.lit(1)).alias("__t_n"))
    joined = completions.join(one.where(once(F.col("__t_n"), "prompts")), on=key, how="left" if strict else "inner")
    if not strict:
        return joined.drop("__t_n")
    lost = F.raise_error(F.concat(F.lit("no prompt for completion key "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.where(F.when(F.col("__t_n").isNull(), lost.cast("boolean")).otherwise(True)).drop("__t_n")


# ---- group statistics (A9, W3) and debug sampling (W2) ---------------------------

def group_stats(df: DataFrame, key: str | Sequence[str] = "prompt_id", reward: str = "total",
                ddof: int = 0) -> DataFrame:
    """Per-group count, null count, mean and spread of a reward (partial + final
    aggregate); null rewards (null answers) are excluded from the statistics."""
    keys = [key] if isinstance(key, str) else list(key)
    std = F.stddev_pop(reward) if ddof == 0 else F.stddev_samp(reward)
    return df.groupBy(*keys).agg(F.count(reward).alias("n"),
                                 (F.count(F.lit(1)) - F.count(reward)).alias("n_null"),
                                 F.avg(reward).alias("reward_mean"),
                                 std.alias("reward_std"), F.min(reward).alias("reward_min"),
                                 F.max(reward).alias("reward_max"))


def group_advantage(df: DataFrame, key: str | Sequence[str] = "prompt_id", reward: str = "total",
                    out: str = "advantage", ddof: int = 0, materialize: bool = False, eps: float = 0.0) -> DataFrame:
    """Group-relative advantage ``(r - mean) / std`` per prompt; std 0 -> 0.

    Lazy, and the input is read once: its rows are dealt out by (prompt, input partition) in one exchange, which all three uses share.
    Small prompts stay together, a hot prompt is split into as many parts as input partitions hold it. Statistics are
    aggregated from the parts (one row a part, then one a prompt) and go back to the parts, so no task gets all rows of a prompt.

    ``eps`` is added to the standard deviation (some GRPO trainers use a
    small constant); with the default 0 a zero spread gives advantage 0.
    ``materialize=True`` cuts the input's lineage with a checkpoint in the shared folder first, when the query runs.
    """
    if materialize:
        from tessera.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=False)
    keys = [key] if isinstance(key, str) else list(key)
    std = F.stddev_pop(reward) if ddof == 0 else F.stddev_samp(reward)
    # a struct is never null: joins on it add no filter below the exchange, and a null key is a group like any other
    rows = df.withColumns({"__t_key": F.struct(*keys), "__t_part": F.spark_partition_id()}).repartition("__t_key", "__t_part")
    # the uses share the exchange only if they read the same columns: a sum over all of them, which no filter can do without, keeps them
    whole = F.bit_xor(F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t])).alias("__t_all")
    stats = rows.groupBy("__t_key").agg(F.avg(reward).alias("__t_mean"), std.alias("__t_std"), whole).where("__t_all is not null").drop("__t_all")
    parts = rows.groupBy("__t_key", "__t_part").agg(whole).where("__t_all is not null").drop("__t_all").join(stats, on="__t_key")
    joined = rows.join(parts, on=["__t_key", "__t_part"], how="left").drop("__t_key", "__t_part")
    adv = F.when(F.col(reward).isNull(), F.lit(None).cast("double")) \
           .when(F.coalesce(F.col("__t_std"), F.lit(0.0)) == 0, F.lit(0.0)) \
           .otherwise((F.col(reward) - F.col("__t_mean")) / (F.col("__t_std") + F.lit(eps)))
    return joined.withColumn(out, adv).drop("__t_mean", "__t_std")


def hash_bucket(key_cols: Sequence[str], seed: int = 0) -> Column:
    """Deterministic 32-bit bucket from md5 (same value in Spark and DuckDB)."""
    k = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint")


def with_answer_verdict(df: DataFrame, completion: str = "completion", answer: str = "answer",
                        tags: Tags = DEFAULT_TAGS, out: str = "verdict",
                        solution_out: str | None = None) -> DataFrame:
    """R5 as a staged projection (solution, numbers, then the label)."""
    staged, ctx, tmp = _stage_intermediates(df, completion, answer, ["answer"], "package", tags)
    res = staged.withColumn(out, _verdict_expr(ctx["sol"], F.col(answer), ctx["x"], ctx["e"], ctx["r"]))
    if solution_out:
        res = res.withColumn(solution_out, ctx["sol"])
    return res.drop(*tmp)


def debug_sample(df: DataFrame, every: int, key_cols: Sequence[str], completion: str = "completion",
                 answer: str = "answer", tags: Tags = DEFAULT_TAGS, seed: int = 0) -> DataFrame:
    """W2 re-aimed: a deterministic 1-in-``every`` sample with verdict, extracted,
    expected and a 200-character preview; hash-selected, so it needs no
    global ordering and no single-partition window.
    """
    picked = df.where(F.pmod(hash_bucket(key_cols, seed), F.lit(every)) == 0)
    v = with_answer_verdict(picked, completion, answer, tags, "verdict", "extracted")
    return v.select(*key_cols, "verdict", "extracted", F.col(answer).alias("expected"),
                    preview(completion, 200).alias("preview"))
