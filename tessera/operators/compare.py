"""Side-by-side model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.functions.tags import DEFAULT_TAGS, Tags
from tessera.functions.text import col, contains
from tessera.operators.ranges import Ranges, fresh

# --- fixed values: pair outcome texts (C2) and summary findings (C3) --------
OUTCOME_TEXT = {
    "tuned_only": "**SFT model successfully learned the format!**",
    "both": "**Both models follow format** (compare proof quality manually)",
    "neither": "**Neither model follows format correctly**",
    "base_only": "**Base model better than SFT** (unexpected)",
}
FINDING_TEXT = {
    "improved": "Fine-tuning **improved** format adherence by {improvement} examples.",
    "equal": "Both models performed **equally** on format adherence.",
    "decreased": "Fine-tuning **decreased** format adherence (needs investigation).",
}
# -----------------------------------------------------------------------------


def format_check(c, tags: Tags = DEFAULT_TAGS) -> Column:
    """Three-tag format struct (the reasoning-start tag is part of the prompt)."""
    re_, ss, se = (contains(c, tags.reasoning_end), contains(c, tags.solution_start),
                   contains(c, tags.solution_end))
    return F.struct(re_.alias("has_reasoning_end"), ss.alias("has_solution_start"),
                    se.alias("has_solution_end"), (re_ & ss & se).alias("format_ok"))


def with_format_check(df: DataFrame, response: str = "response", out: str = "format_check",
                      tags: Tags = DEFAULT_TAGS) -> DataFrame:
    return df.withColumn(out, format_check(response, tags))


def once(n: Column, what: str) -> Column:
    """``n == 1`` as a filter that raises, when the query runs, where ``n`` is larger."""
    more = F.raise_error(F.concat(F.lit(f"{what}: a key occurs "), n.cast("string"), F.lit(" times"))).cast("boolean")
    return F.when(n > 1, more).otherwise(n == 1)


def pair_models(results: DataFrame, base: str = "base", tuned: str = "tuned",
                key: str = "problem_id", model: str = "model",
                value_cols: Sequence[str] = ("response", "format_check"),
                check_unique: bool = True) -> DataFrame:
    """Pair two models' rows on the problem key (inner, like ``zip`` truncation).

    ``results`` is the long table ``(key, model, ...)`` with one row per (key, model); a second
    row raises when the query runs, unless ``check_unique=False`` (then any one counts). One
    aggregate on the key gathers both sides, so the input is read and shuffled once.
    """
    extra = [c for c in results.columns if c not in (key, model, *value_cols)]
    is_base, is_tuned = F.col(model) == base, F.col(model) == tuned
    aggs, out = [F.count_if(is_base).alias("_nb"), F.count_if(is_tuned).alias("_nt")], []
    sides = [("_b", is_base, [(c, c) for c in extra] + [(v, f"base_{v}") for v in value_cols]), ("_t", is_tuned, [(v, f"sft_{v}") for v in value_cols])]
    for side, chosen, columns in sides:
        if check_unique:
            for k, (c, name) in enumerate(columns):
                found, built = _first(results, c, chosen, f"{side}{k}")
                aggs += found
                out.append(built.alias(name))
        else:  # any one row, but whole
            aggs.append(F.first(F.when(chosen, F.struct(*[c for c, _ in columns])), ignorenulls=True).alias(side))
            out += [F.col(side)[c].alias(name) for c, name in columns]
    paired = results.where(is_base | is_tuned).groupBy(key).agg(*aggs)
    if check_unique:
        paired = paired.where(once(F.col("_nb"), "model results") & once(F.col("_nt"), "model results"))
    else:
        paired = paired.where("_nb > 0 and _nt > 0")
    return paired.select(key, *out)


def _first(df: DataFrame, name: str, chosen: Column, alias: str) -> tuple[list[Column], Column]:
    """Aggregates that take a column from the one chosen row, and the expression that builds it again.

    A struct is taken field by field: what a query does not use is pruned, and what is no text takes a hash aggregate.
    """
    field = df.schema[name]
    if not isinstance(field.dataType, StructType):
        return [F.first(F.when(chosen, F.col(name)), ignorenulls=True).alias(alias)], F.col(alias)
    aggs = [F.first(F.when(chosen, F.col(name)[f]), ignorenulls=True).alias(f"{alias}_{k}") for k, f in enumerate(field.dataType.names)]
    built = F.struct(*[F.col(f"{alias}_{k}").alias(f) for k, f in enumerate(field.dataType.names)])
    if field.nullable:
        aggs.append(F.bool_or(chosen & F.col(name).isNotNull()).alias(f"{alias}_is"))
        built = F.when(F.col(f"{alias}_is"), built)
    return aggs, built


# ---- any number of models ----------------------------------------------------------

#: models in one word of a bitset
WORD = 60


def model_bits(results: DataFrame, models: Sequence[str], ok: str = "format_check.format_ok", key: str = "problem_id", model: str = "model",
               check_unique: bool = True) -> DataFrame:
    """J2 for N models: one row per problem with two bitsets, ``present0 ...`` (models with a row) and ``passed0 ...`` (models that pass).

    Bit ``k`` of word ``w`` is ``models[WORD * w + k]``; a null ``ok`` is no pass. One hash aggregate of longs on the problem key; texts are
    never read. A repeated (problem, model) raises when the query runs, unless ``check_unique=False`` (then it passes if any row does).
    """
    if not models or len(set(models)) != len(models):
        raise ValueError("models must be named once each")
    place = F.create_map(*[x for k, m in enumerate(models) for x in (F.lit(m), F.lit(k))])[F.col(model)]
    rows = results.select(F.col(key).alias(key), place.alias("_k"), F.coalesce(F.col(ok), F.lit(False)).alias("_ok")).where("_k is not null")
    words = range((len(models) + WORD - 1) // WORD)
    aggs = []
    for w in words:
        bit = F.expr(f"case when _k div {WORD} = {w} then shiftleft(1L, _k % {WORD}) else 0L end")
        aggs += [F.bit_or(bit).alias(f"present{w}"), F.bit_or(F.when(F.col("_ok"), bit).otherwise(F.lit(0).cast("long"))).alias(f"passed{w}")]
    bits = rows.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    if check_unique:
        held = sum((F.bit_count(f"present{w}") for w in words), F.lit(0))
        bits = bits.where(once(F.col("_n") - held + 1, "model results"))
    return bits.drop("_n")


def _pairs_of(bits: DataFrame, models: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` and, for each two models that are present, base, tuned, base_ok, tuned_ok; the models in their given order."""
    def bit(kind: str, k: int) -> str:
        return f"(shiftright({kind}{k // WORD}, {k % WORD}) & 1L) = 1L"

    each = [f"if({bit('present', i)} and {bit('present', j)}, named_struct('i', {i}, 'j', {j}, 'base_ok', {bit('passed', i)}, 'tuned_ok', {bit('passed', j)}), null)"
            for i in range(len(models)) for j in range(i + 1, len(models))]
    name = F.array(*map(F.lit, models))
    rows = bits.select(*columns, F.explode(F.expr(f"filter(array({', '.join(each)}), x -> x is not null)")).alias("p"))
    return rows.select(*columns, name[F.col("p.i")].alias("base"), name[F.col("p.j")].alias("tuned"), "p.base_ok", "p.tuned_ok")


def pair_outcomes(results: DataFrame, models: Sequence[str], ok: str = "format_check.format_ok", key: str = "problem_id", model: str = "model") -> DataFrame:
    """J2 + C2 for N models: problem, base, tuned, base_ok, tuned_ok, outcome of each two models (in their given order) that both answer it."""
    if len(models) < 2:
        raise ValueError("a comparison needs two models")
    rows = _pairs_of(model_bits(results, models, ok, key, model), models, [key])
    return rows.withColumn("outcome", pair_outcome("base_ok", "tuned_ok"))


def pair_matrix(results: DataFrame, models: Sequence[str], ok: str = "format_check.format_ok", key: str = "problem_id", model: str = "model") -> DataFrame:
    """A5 + C3 for N models: one row per two models with outcome counts, accuracies, improvement and finding.

    Problems with equal bitsets are counted together before the pairs are spread out, so that pairs are made
    per combination of passes, not per problem; two models without a common problem have a row of zeros and null accuracies.
    """
    if len(models) < 2:
        raise ValueError("a comparison needs two models")
    bits = model_bits(results, models, ok, key, model)
    words = [c for c in bits.columns if c != key]
    kinds = bits.groupBy(*words).agg(F.count(F.lit(1)).alias("_n"))
    rows = _pairs_of(kinds, models, ["_n"])
    spark = results.sparkSession
    every = spark.createDataFrame([(a, b) for i, a in enumerate(models) for b in models[i + 1:]], "base string, tuned string")  # the caller's list
    every = every.select("*", F.lit(0).cast("long").alias("_n"), F.lit(False).alias("base_ok"), F.lit(False).alias("tuned_ok"))
    b, t = F.col("base_ok"), F.col("tuned_ok")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    agg = rows.select(*every.columns).unionByName(every).groupBy("base", "tuned").agg(
        total(b & t).alias("both"), total(b & ~t).alias("base_only"), total(~b & t).alias("tuned_only"), total(~b & ~t).alias("neither"),
        total(b).alias("base_correct"), total(t).alias("tuned_correct"), F.sum("_n").alias("num_problems"))
    imp = F.col("tuned_correct") - F.col("base_correct")
    return agg.select("*", F.try_divide(F.col("base_correct").cast("double"), F.col("num_problems")).alias("base_accuracy"),
                      F.try_divide(F.col("tuned_correct").cast("double"), F.col("num_problems")).alias("tuned_accuracy"), imp.alias("improvement"),
                      F.when(imp > 0, F.lit("improved")).when(imp == 0, F.lit("equal")).otherwise(F.lit("decreased")).alias("finding"))


def pair_outcome(base_ok, tuned_ok) -> Column:
    """Tuned only / both / neither / base only."""
    b, t = col(base_ok), col(tuned_ok)
    return (F.when(t & ~b, F.lit("tuned_only")).when(b & t, F.lit("both"))
             .when(~b & ~t, F.lit("neither")).otherwise(F.lit("base_only")))


def outcome_text(outcome: Column) -> Column:
    m = F.create_map(*[x for k, v in OUTCOME_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return m[outcome]


def pair_summary(pairs: DataFrame, base_ok: str = "base_format_check.format_ok",
                 tuned_ok: str = "sft_format_check.format_ok", by: Sequence[str] = ()) -> DataFrame:
    """A5 + C3: pass counts, accuracies, improvement and the direction finding."""
    n = F.count(F.lit(1))
    agg = pairs.groupBy(*by).agg(
        F.count_if(F.col(base_ok)).alias("base_model_correct"),
        F.count_if(F.col(tuned_ok)).alias("sft_model_correct"),
        n.alias("num_problems"))
    imp = F.col("sft_model_correct") - F.col("base_model_correct")
    return agg.select(
        *by, "base_model_correct", "sft_model_correct", "num_problems",
        F.try_divide(F.col("base_model_correct").cast("double"), F.col("num_problems")).alias("base_model_accuracy"),
        F.try_divide(F.col("sft_model_correct").cast("double"), F.col("num_problems")).alias("sft_model_accuracy"),
        imp.alias("improvement"),
        F.when(imp > 0, F.lit("improved")).when(imp == 0, F.lit("equal"))
         .otherwise(F.lit("decreased")).alias("finding"))


def single_summary(results: DataFrame, ok: str = "format_check.format_ok",
                   by: Sequence[str] = ()) -> DataFrame:
    """Single-model pass count and accuracy."""
    return results.groupBy(*by).agg(
        F.count_if(F.col(ok)).alias("correct_format"),
        F.avg(F.col(ok).cast("int")).alias("accuracy"),
        F.count(F.lit(1)).alias("num_problems"))


def number_rows(df: DataFrame, order: Sequence[str], out: str = "problem_number",
                partitions: int | None = None) -> DataFrame:
    """1-based dense numbering in ``order`` as a lazy two-pass prefix sum; no job runs while the query is built.

    The range of a row is the number of bounds below its key. The bounds are the quantiles of a sample of keys that a hash selects, so
    they are the same whenever they are computed again. Rows are numbered within their range and
    shifted by the rows of all ranges before it. Sample and range counts are scalar subqueries over the order columns only, bounded
    by the number of ranges; the other columns move once. ``order`` should tell rows apart: equal keys share a range and any order.
    """
    b = fresh(df, "_range")
    ranges = Ranges(df, order, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), b)
    within = F.row_number().over(Window.partitionBy(b).orderBy(*order))
    return ranges.place(df).withColumn(out, (ranges.rows_before() + within).cast("long")).drop(b)
