"""One line for each group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SOLVE_FAILURES, FitError
from ..schema import MAX_GROUP_BYTES, FitSchema
from ..sources.text import TextTable
from .kernels import solve_factor, solve_moments
from .moments import SQL_TERMS, states

FITS = (
    "group string, rows long, first long, failure string, intercept double, coef array<double>, status array<string>, df long, r2 double, r2_status string, "
    "resid_sd double, is_bound boolean, cond double, pinned int, centre array<double>, y_mean double, response_sd double"
)


def solve(state: DataFrame, solver: str = "normal") -> DataFrame:
    """FITS from states, group by group where they are: no exchange."""
    factor = solver == "qr"

    def one(row) -> dict:
        mean, c = np.array(row["mean"], float), np.array(row["c"], float)
        w = len(mean)
        c = c.reshape(w, w)
        lo, hi = np.array(row["lo"], float), np.array(row["hi"], float)
        n = int(row["n"])
        if row["bad"]:
            out = solve_moments(0, mean, c)
        elif factor:
            r = np.array(row["r"], float).reshape(w + 1, w + 1)
            out = solve_factor(n, r, np.append(np.sqrt(n), np.array(row["norm"], float)[: w - 1]), lo[: w - 1], hi[: w - 1], float(c[-1, -1]))
        else:
            out = solve_moments(n, mean, c)
        with np.errstate(all="ignore"):
            centre = (lo + hi)[: w - 1] / 2 if factor else mean[: w - 1]
        return out | {"group": row["group"], "rows": n, "first": int(row["first"]), "centre": centre.tolist(), "y_mean": float(mean[-1]), "response_sd": float(np.sqrt(c[-1, -1] / (n - 1))) if n > 1 else None}

    names = [f.split()[0] for f in FITS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [one(row) for row in frame.to_dict("records")]
            out = pd.DataFrame(rows, columns=names)
            for c in ("df", "pinned"):
                out[c] = out[c].astype("Int64")
            yield out

    return state.mapInPandas(run, FITS)


@dataclass
class FitResult:
    schema: FitSchema
    solver: str
    selection: str | None
    train: DataFrame
    fits: DataFrame

    @cached_property
    def kept(self) -> DataFrame:
        """The fits, computed once for whatever needs them again; lost parts are computed anew."""
        return self.fits.persist()

    @cached_property
    def groups(self) -> int:
        return self.kept.count()

    @property
    def model(self) -> DataFrame:
        """group, intercept, coef, term_status, and first: the place of the group's first row."""
        return self.kept.select("group", "intercept", "coef", F.col("status").alias("term_status"), "first")

    @property
    def wide(self) -> DataFrame:
        """group, intercept and a column for each term."""
        return self.kept.select("group", "intercept", *[F.col("coef")[k].alias(t) for k, t in enumerate(self.schema.terms)])

    @property
    def stats(self) -> DataFrame:
        return self.kept.select("group", "rows", "df", "r2", "r2_status", "resid_sd", F.col("is_bound").alias("resid_sd_is_bound"), "cond", "pinned")

    @cached_property
    def summary(self) -> DataFrame:
        """One row over all groups."""
        f = self.kept
        return f.agg(
            F.count("*").alias("groups"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("pinned"), F.lit(0)).cast("long").alias("pinned"),
            F.min("df").alias("min_df"),
            F.greatest(F.lit(1.0), F.max("cond")).alias("max_condition"),
            F.min("r2").alias("min_r2"),
            F.count_if(F.col("r2_status") == "FLAT_Y").alias("groups_flat_y"),
            F.count_if(F.col("r2_status") == "LOST").alias("groups_r2_lost"),
            F.max("resid_sd").alias("max_sigma"),
            F.max_by("is_bound", "resid_sd").alias("sigma_is_bound"),
        )

    def check(self) -> FitResult:
        """Raises FitError unless every group could be fitted. All groups are looked at before anything is written."""
        failed = F.col("failure")
        got = self.kept.agg(
            F.count("*").alias("groups"),
            F.sum("rows").alias("rows"),
            F.min_by(F.struct("group", failed.alias("failure")), F.when(failed.isNotNull(), F.col("first"))).alias("bad"),
            F.min_by("group", F.when(F.col("group").isNull() | (F.octet_length("group") == 0) | (F.octet_length("group") > MAX_GROUP_BYTES), F.col("first"))).alias("name"),
            F.count_if(F.col("group").isNull() | (F.octet_length("group") == 0) | (F.octet_length("group") > MAX_GROUP_BYTES)).alias("names"),
        ).first()
        if not got["groups"]:
            raise FitError("NO_ROWS" if self.selection in (None, "*") else "GROUP_NOT_FOUND", "no data rows" if self.selection in (None, "*") else f"no rows for group {self.selection!r}")
        if got["names"]:
            raise FitError("BAD_GROUP", f"the group {got['name']!r} is empty or longer than {MAX_GROUP_BYTES} bytes")
        if self.selection is None and got["rows"] >= 3 and got["rows"] == got["groups"]:
            raise FitError("ALL_SINGLETON", "every row is a group of its own: the group column seems to be missing")
        if got["bad"] and got["bad"]["failure"]:
            raise FitError(got["bad"]["failure"], f"group {got['bad']['group']!r}: {SOLVE_FAILURES[got['bad']['failure']]}")
        return self


def fit(df: DataFrame | TextTable, schema: FitSchema | None = None, solver: str = "normal", group: str | None = None, sql_terms: int = SQL_TERMS) -> FitResult:
    """Fits each group of a training table; `group` names the one to fit, or '*' pools all. Of a file that was read, any refused row refuses the fit, and `first` follows its lines.

    Nothing runs until a result is used; `check` says whether all is well. With a
    group named, rows of other groups that aren't numbers still refuse the fit, so
    the group is selected after the aggregation, where it costs no more.
    """
    if solver not in ("normal", "qr"):
        raise FitError("BAD_SOLVER", f"{solver!r} is neither 'normal' nor 'qr'")
    if isinstance(df, TextTable):
        schema, train = df.schema, df.check().rows
        train = train.withColumn("group", F.lit("*")) if group == "*" else train
    else:
        schema = schema or FitSchema.of(df.columns)
        train = schema.training(df, "*" if group == "*" else None)
    fits = solve(states(train, schema.p, solver, sql_terms), solver)
    if group not in (None, "*"):
        # the chosen group's row, and whether any group holds what is not a number, from one aggregation
        chosen = F.first(F.when(F.col("group") == group, F.struct(*fits.columns)), ignorenulls=True)
        both = fits.agg(chosen.alias("f"), F.max(F.col("failure") == "NOT_FINITE").alias("refused")).where("f is not null")
        fits = both.select("f.*", "refused").withColumn("failure", F.when(F.col("refused"), "NOT_FINITE").otherwise(F.col("failure"))).drop("refused")
        train = train.where(F.col("group") == group)
    return FitResult(schema, solver, group, train, fits)
