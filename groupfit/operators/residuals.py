"""What the lines leave over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FitError
from ..functions.numbers import predict
from .fit import FitResult
from .score import fits_in


def with_fit(result: FitResult) -> DataFrame:
    """Training rows joined to their group's fit, as a second pass over the source. Rows of groups without a fit are skipped.

    The first pass ends before the second begins, so the number of groups is known: while they take few bytes they are broadcast, and rows are not shuffled.
    """
    if result.train.isStreaming:
        raise FitError("RESIDUALS_NEED_FILE", "residuals need a second pass over the rows, which a stream can't give")
    fits = result.kept.where("failure is null").select("group", "intercept", "coef", "centre", "y_mean", "resid_sd", "response_sd", "first")
    return result.train.join(F.broadcast(fits) if fits_in(result.groups, 2 * result.groups * result.schema.p) else fits, "group").withColumn("predicted", predict(F.col("intercept"), F.col("coef"), F.col("x"))).withColumn("residual", F.col("y") - F.col("predicted"))


def residuals(result: FitResult) -> DataFrame:
    """group, observed, predicted, residual for each training row."""
    return with_fit(result).select("group", F.col("y").alias("observed"), "predicted", "residual")
