"""What to say about a fit: one line of figures, and warnings where they mislead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fit import FitResult

ILL_CONDITIONED = 1e8
NAMES = {"normal": "normal equations", "qr": "QR"}


def some(n: int, what: str) -> str:
    return f"{n} {what}" + "s" * (n != 1)


def report(result: FitResult, shape: dict | None = None) -> list[str]:
    """Lines about a fit. `shape`: a row of `diagnostics.summary`, if residuals were looked at."""
    s, qr = result.summary.first().asDict(), result.solver == "qr"
    many = s["groups"] != 1
    worst, least = ("worst ", "least ") if many else ("", "")
    figures = [some(s["groups"], "group"), some(s["rows"], "row")] if many else [some(s["rows"], "row")]
    if s["min_r2"] is not None:
        figures.append(f"{worst}R2={s['min_r2']:.4f}")
    if s["max_sigma"] is not None:
        figures.append(f"{worst}resid SD{'<' if s['sigma_is_bound'] else '='}{s['max_sigma']:.4g}")
    if s["pinned"]:
        figures.append(f"{some(s['pinned'], 'term')} unidentified and set to 0")
    figures.append(f"{least}df={s['min_df']}")
    if s["max_condition"] > 1:
        figures.append(f"{worst}cond={s['max_condition']:.3g} ({NAMES[result.solver]}{', over the terms kept' if s['pinned'] else ''})")
    lines = [result.schema.reading(), "fit: " + ", ".join(figures)]
    warn = lambda text: lines.append("warning: " + text)
    if s["min_df"] <= 0:
        warn("some group has no residual degrees of freedom: its line goes through every row by construction. Fit it on more rows.")
    if s["groups_flat_y"]:
        warn(f"{some(s['groups_flat_y'], 'group')} without R2, because the response does not vary there: it is undefined, not zero.")
    if s["groups_r2_lost"]:
        warn(f"{some(s['groups_r2_lost'], 'group')} without R2, because the subtraction has no digits left. Rescale the response{'' if qr else ', or use the QR solver'}.")
    if shape and shape["curved_term"] is not None:
        warn(f"in group {shape['worst_group']} the residuals still depend on {shape['curved_term']} (t={shape['curved_t']:.1f}). Consider adding its {'cube' if shape['curved_pow'] == 3 else 'square'} as a column.")
    elif shape and shape["fitted_t"]:
        warn(f"the residuals still depend on the prediction (t={shape['fitted_t']:.1f}): the model has the wrong shape.")
    if shape and shape["spread_t"]:
        also = shape["curved_term"] is not None or shape["fitted_t"]
        warn(f"the size of the residual moves with the prediction (t={shape['spread_t']:.1f}). {'The wrong shape can do this by itself: mend that first.' if also else 'The error is not the same everywhere.'}")
    if s["max_condition"] > ILL_CONDITIONED:
        warn(f"{'some group' if many else 'the design'} is ill-conditioned (cond={s['max_condition']:.3g}): the last digits of its coefficients are noise.{'' if qr else ' Try the QR solver, which does not square the condition number.'}")
    return lines


def pinned_note(group: Column, status: Column, terms: tuple[str, ...]) -> Column:
    """'# pinned G: constant a,b collinear c', null where all terms are fitted."""
    names = F.array(*[F.lit(t) for t in terms])
    pairs = F.zip_with(names, status, lambda n, s: F.struct(n.alias("n"), s.alias("s")))
    part = lambda kind: F.array_join(F.transform(F.filter(pairs, lambda q: q["s"] == kind), lambda q: q["n"]), ",")
    constant, collinear = part("CONSTANT"), part("COLLINEAR")
    text = F.concat(F.lit("# pinned "), group, F.lit(":"), F.when(constant != "", F.concat(F.lit(" constant "), constant)).otherwise(""), F.when(collinear != "", F.concat(F.lit(" collinear "), collinear)).otherwise(""))
    return F.when((constant != "") | (collinear != ""), text)


def pinned_notes(result: FitResult) -> DataFrame:
    return result.fits.where("pinned > 0").select("group", pinned_note(F.col("group"), F.col("status"), result.schema.terms).alias("note"))
