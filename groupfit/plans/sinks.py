"""Results as text, in the order in which groups were first seen. Tables are better kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import printed, significant
from ..operators.fit import FitResult
from .report import pinned_note


def model_lines(result: FitResult) -> DataFrame:
    """(ord, part, line): the coefficient table. A fit of one chosen group or of the pool does not name the response."""
    s = result.schema
    spark = result.fits.sparkSession
    head = [(-1, 1, ",".join(["group", "intercept", *s.terms]))]
    if result.selection is None:
        head.append((-1, 0, f"# response: {s.response}"))
    values = F.concat_ws(",", "group", significant(F.col("intercept")), *[significant(F.col("coef")[k]) for k in range(s.p)])
    rows = result.fits.select(F.col("first").alias("ord"), F.lit(0).alias("part"), values.alias("line"))
    notes = result.fits.select(F.col("first").alias("ord"), F.lit(1).alias("part"), pinned_note(F.col("group"), F.col("status"), s.terms).alias("line")).where("line is not null")
    return spark.createDataFrame(head, "ord long, part int, line string").unionByName(rows).unionByName(notes)


def stats_lines(result: FitResult) -> DataFrame:
    """(ord, part, line): group,rows,df,r2,resid_sd,cond,pinned, with blanks for what is undefined and < before a bound."""
    spark = result.fits.sparkSession
    sd = F.when(F.col("resid_sd").isNull(), "").otherwise(F.concat(F.when(F.col("is_bound"), "<").otherwise(""), significant(F.col("resid_sd"))))
    r2 = F.when(F.col("r2").isNull(), "").otherwise(printed(F.col("r2"), "%.6f"))
    line = F.concat_ws(",", "group", F.col("rows").cast("string"), F.col("df").cast("string"), r2, sd, significant(F.col("cond"), 6), F.col("pinned").cast("string"))
    head = spark.createDataFrame([(-1, 0, "group,rows,df,r2,resid_sd,cond,pinned")], "ord long, part int, line string")
    return head.unionByName(result.fits.select(F.col("first").alias("ord"), F.lit(0).alias("part"), line.alias("line")))


def residual_lines(residuals: DataFrame) -> DataFrame:
    return residuals.select(F.concat_ws(",", "group", *[significant(F.col(c)) for c in ("observed", "predicted", "residual")]).alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    """One text file of lines with ord and part, in their order. A failed write fails."""
    lines.repartition(1).sortWithinPartitions("ord", "part").select("line").write.text(path)
