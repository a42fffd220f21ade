"""Cases against a fitted model. Each row stands alone: one that can't be scored doesn't stop the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import check_scale, parse_number, predict, round_half_away, trim_point
from ..schema import fold, fold_column

#: Bytes of a model that may be broadcast, and what a group takes beside its numbers.
FEW_BYTES, GROUP_BYTES = 64 << 20, 128


def fits_in(groups: int, numbers: int) -> bool:
    """May a table of so many groups, with so many numbers in all, be broadcast?"""
    return GROUP_BYTES * groups + 8 * numbers <= FEW_BYTES


def side(model: DataFrame) -> DataFrame:
    """The model to join cases with: broadcast if it is known to be small, so that cases are not shuffled."""
    numbers = F.sum(F.size("coef")) if "coef" in model.columns else F.lit(0)
    groups, total = model.agg(F.count("*"), F.coalesce(numbers, F.lit(0))).first()
    return F.broadcast(model) if fits_in(groups, total) else model


def with_trims(model: DataFrame, trims: DataFrame | None) -> DataFrame:
    """The model with trim_addition (0 where a group has none) and has_trims: did any group of the trim table match? Of several rows for a group the last wins; unknown groups are ignored."""
    if trims is None:
        return model.withColumn("trim_addition", F.lit(0.0)).withColumn("has_trims", F.lit(False))
    ordered = trims if "row_id" in trims.columns else trims.withColumn("row_id", F.monotonically_increasing_id())
    last = ordered.groupBy("group").agg(F.max_by("trim_addition", "row_id").alias("trim_addition"))
    matched = not last.join(model.select("group"), "group", "left_semi").isEmpty()
    return model.join(last, "group", "left").withColumn("trim_addition", F.coalesce("trim_addition", F.lit(0.0))).withColumn("has_trims", F.lit(matched))


def score_rows(cases: DataFrame, model: DataFrame, trims: DataFrame | None = None, scale: int = 4, trim_scale: int = 1) -> DataFrame:
    """cases: group, x (in the model's term order) and any other columns. Adds prediction and trim (null if there is no trim table); cases of unknown groups are left out, see `unknown_groups`."""
    scale, trim_scale = check_scale(scale), check_scale(trim_scale)
    known = with_trims(model.select("group", "intercept", "coef"), trims)
    raw = predict(F.col("intercept"), F.col("coef"), F.col("x"))
    trim = F.when(F.col("has_trims"), trim_point(raw, F.col("trim_addition"), scale, trim_scale))
    return cases.join(side(known), "group").withColumns({"prediction": round_half_away(raw, scale), "trim": trim}).drop("intercept", "coef", "trim_addition", "has_trims")


def unknown_groups(cases: DataFrame, model: DataFrame) -> DataFrame:
    return cases.join(side(model.select("group")), "group", "left_anti")


def named_case(assignments: Column, terms: list[str] | tuple[str, ...]) -> tuple[Column, Column]:
    """(x, refusal) of an array of texts 'term=value': terms that aren't mentioned are 0, a later value replaces an earlier one, and the refusal is the first thing wrong or null."""
    names = F.array(*[F.lit(fold(t)) for t in terms])
    pairs = F.transform(assignments, lambda a: F.struct(F.instr(a, "=").alias("at"), fold_column(F.trim(F.substring_index(a, "=", 1))).alias("term"), parse_number(F.substring(a, F.instr(a, "=") + 1, F.length(a))).alias("value")))
    wrong = F.transform(pairs, lambda q: F.when(q["at"] == 0, "NOT_ASSIGNMENT").when(~F.array_contains(names, q["term"]), "UNKNOWN_TERM").when(q["value"].isNull(), "BAD_VALUE"))
    x = F.transform(names, lambda t: F.coalesce(F.try_element_at(F.filter(pairs, lambda q: q["term"] == t), F.lit(-1))["value"], F.lit(0.0)))
    return x, F.try_element_at(F.filter(wrong, lambda w: w.isNotNull()), F.lit(1))


def score_named(cases: DataFrame, model: DataFrame, terms: list[str] | tuple[str, ...], trims: DataFrame | None = None, scale: int = 4, trim_scale: int = 1) -> DataFrame:
    """cases: group, assignments (array of 'term=value') and any other columns. Rows with anything wrong are left out; `named_case` says what."""
    x, refusal = named_case(F.col("assignments"), terms)
    fine = cases.withColumns({"x": x, "refusal": refusal}).where("refusal is null").drop("refusal")
    return score_rows(fine, model, trims, scale, trim_scale).drop("x")


def score_text(scored: DataFrame, scale: int = 4, trim_scale: int = 1) -> DataFrame:
    """One line of text a scored case."""
    line = F.concat(F.col("group"), F.lit(" prediction="), F.format_string(f"%.{scale}f", "prediction"))
    return scored.withColumn("line", F.when(F.col("trim").isNull(), line).otherwise(F.concat(line, F.lit(" trim="), F.format_string(f"%.{trim_scale}f", "trim"))))
