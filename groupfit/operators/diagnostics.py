"""Evidence in the residuals that a line is the wrong shape.

One aggregation gives sums of powers for each group and probe column: the terms
about their centres, and the fitted value about the mean response, which comes
last. All the statistics are arithmetic on those sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fit import FitResult
from .moments import HELD, Names, heads_of
from .residuals import with_fit
from .score import fits_in

#: Bound on one t, cap on any t, least rows of a group, and the least share of the response's spread that residuals must have.
T, CAP, LEAST_ROWS, LEAST_SHARE = 3.5, 9999.0, 10, 1e-6


def power_sums(result: FitResult) -> DataFrame:
    """group, probe (place of the term, or their number for the fitted value), n and sums su1..su6 of powers of u, sr1, sr2, sr4 of the residual, sru1..sru3 of r * u**k, sw1, sw2 of r**2 * u**k, sa1 and sau1 of |r| and |r| * u."""
    rows = with_fit(result)
    columns = F.concat(F.zip_with("x", "centre", lambda x, c: x - c), F.array(F.col("predicted") - F.col("y_mean")))
    finite = ~F.isnan("residual") & (F.abs("residual") < float("inf")) & ~F.isnan("predicted") & (F.abs("predicted") < float("inf"))
    some = rows.where(finite).select("group", "resid_sd", "response_sd", "first", F.col("residual").alias("r"), columns.alias("u"))
    if result.schema.p > SQL_PROBES:
        each = some.select("group", "r", *[F.col("u")[k].alias(f"u{k}") for k in range(result.schema.p + 1)]).mapInArrow(summed(result.schema.p + 1), "group string, probe int, n long, " + ", ".join(f"{k} double" for k in SUMS))
        known = result.kept.where("failure is null").select("group", "resid_sd", "response_sd", "first")
        each = each.groupBy("group", "probe").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in SUMS])
        return each.join(known if not fits_in(result.groups, 3 * result.groups) else F.broadcast(known), "group")
    each = some.select("*", F.posexplode("u").alias("probe", "v")).drop("u")
    u, r = F.col("v"), F.col("r")
    power = [u]
    for _ in range(5):
        power.append(power[-1] * u)
    sums = dict(zip(SUMS, [*power, r, r * r, r * r * r * r, *(r * x for x in power[:3]), r * r * u, r * r * power[1], F.abs(r), F.abs(r) * u], strict=True))
    return each.groupBy("group", "probe").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()], F.first("resid_sd").alias("resid_sd"), F.first("response_sd").alias("response_sd"), F.first("first").alias("first"))


#: The sums, and the number of terms up to which a row is made into one for each probe; beyond it tasks add up rows in Arrow batches.
SUMS = ("su1", "su2", "su3", "su4", "su5", "su6", "sr1", "sr2", "sr4", "sru1", "sru2", "sru3", "sw1", "sw2", "sa1", "sau1")
SQL_PROBES = 2


def summed(width: int):
    """Rows (group, r, u0, u1, ...) to sums for each group and probe, one row of them a task while they take few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, n, total = Names(), np.zeros(0, np.int64), np.zeros((0, len(SUMS), width))

        def out() -> pa.RecordBatch:
            names = [g for g in groups.known for _ in range(width)]
            flat = total.transpose(0, 2, 1).reshape(-1, len(SUMS))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.tile(np.arange(width, dtype=np.int32), len(n))), pa.array(np.repeat(n, width)), *(pa.array(flat[:, k]) for k in range(len(SUMS)))], ["group", "probe", "n", *SUMS])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = groups.codes(batch.column(0))
            order = np.argsort(code, kind="stable")
            heads = heads_of(code[order])
            r = batch.column(1).to_numpy(zero_copy_only=False)[order, None]
            u = np.column_stack([batch.column(k + 2).to_numpy(zero_copy_only=False) for k in range(width)])[order]
            more = len(groups.known) - len(n)
            n, total = np.append(n, np.zeros(more, np.int64)), np.concatenate([total, np.zeros((more, len(SUMS), width))])
            own = code[order][heads]
            n[own] += np.diff(np.append(heads, len(code)))
            power = [u]
            for _ in range(5):
                power.append(power[-1] * u)
            one = np.ones_like(u)
            for k, x in enumerate((*power, r * one, r * r * one, r**4 * one, r * u, r * power[1], r * power[2], r * r * u, r * r * power[1], np.abs(r) * one, np.abs(r) * u)):
                total[own, k] += np.add.reduceat(x, heads, axis=0)
            if total.nbytes > HELD:
                yield out()
                groups, n, total = Names(), np.zeros(0, np.int64), np.zeros((0, len(SUMS), width))
        if len(n):
            yield out()

    return run


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def centred(ab: Column, a: Column, b: Column) -> Column:
    return ab - a * b / F.col("n")


def dots(sums: DataFrame) -> DataFrame:
    """Adds centred products: dIJ of u**I and u**J, dr1..dr3 of the residual and u**K, drr."""
    s = [F.col("n").cast("double"), *[F.col(f"su{k}") for k in range(1, 7)]]
    out = {f"d{i}{j}": centred(s[i + j], s[i], s[j]) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j}
    out |= {f"dr{k}": centred(F.col(f"sru{k}"), F.col("sr1"), s[k]) for k in (1, 2, 3)} | {"drr": centred(F.col("sr2"), F.col("sr1"), F.col("sr1"))}
    n1, n2 = F.col("su1"), F.col("su2")
    out |= {"dw1": centred(F.col("sw1"), F.col("sr2"), n1), "dw2": centred(F.col("sw2"), F.col("sr2"), n2), "dww": centred(F.col("sr4"), F.col("sr2"), F.col("sr2"))}
    det = {"det": F.col("d11") * F.col("d22") - F.col("d12") * F.col("d12"), "m": ratio(F.col("d12"), F.col("d11"))}
    share = {"a1": ratio(F.col("d13") * F.col("d22") - F.col("d23") * F.col("d12"), F.col("det")), "a2": ratio(F.col("d23") * F.col("d11") - F.col("d13") * F.col("d12"), F.col("det"))}
    return sums.withColumns(out).withColumns(det).withColumns(share)


def square_corr() -> Column:
    """Partial correlation of the residual with u squared, given u."""
    var = F.col("d22") - F.col("m") * F.col("d12")
    cov = F.col("dr2") - F.col("m") * F.col("dr1")
    return F.when((F.col("d11") <= 0) | (F.col("drr") <= 0) | (var <= 0), 0.0).otherwise(ratio(cov, F.sqrt(var * F.col("drr"))))


def cube_corr() -> Column:
    """Partial correlation of the residual with u cubed, given u and u squared."""
    var = F.col("d33") - F.col("a1") * F.col("d13") - F.col("a2") * F.col("d23")
    cov = F.col("dr3") - F.col("a1") * F.col("dr1") - F.col("a2") * F.col("dr2")
    return F.when((F.col("d11") <= 0) | (F.col("drr") <= 0) | (F.col("det") <= 0) | (var <= 0), 0.0).otherwise(ratio(cov, F.sqrt(var * F.col("drr"))))


def t_of(corr: Column, p: int) -> Column:
    df = F.col("n") - p - 2
    t = ratio(corr * F.sqrt(df.cast("double")), F.sqrt(1 - corr * corr))
    exact = F.when(corr < 0, -CAP).otherwise(CAP)
    return F.when(df <= 0, 0.0).when(1 - corr * corr <= 1e-12, exact).otherwise(F.greatest(F.lit(-CAP), F.least(F.lit(CAP), t)))


def spread_share() -> Column:
    """Share of the squared residual's variance that f and f squared explain; of the row of the fitted value."""
    w1, w2 = F.col("dw1"), F.col("dw2")
    explained = ratio((w1 * F.col("d22") - w2 * F.col("d12")) * w1 + (w2 * F.col("d11") - w1 * F.col("d12")) * w2, F.col("det"))
    return F.when((F.col("n") <= 4) | (F.col("dww") <= 0) | (F.col("det") <= 0) | (explained <= 0), 0.0).otherwise(ratio(explained, F.col("dww")))


def spread_t(share: Column) -> Column:
    """Root of half of F with 2 and n - 3 degrees of freedom."""
    return F.when(share <= 0, 0.0).when(share >= 1, CAP).otherwise(F.least(F.lit(CAP), F.sqrt(ratio(share / 2 * (F.col("n") - 3), 1 - share))))


def bound(p: int, groups: int | Column) -> float | Column:
    """What a t must reach among the 2p + 2 probes of each group."""
    if isinstance(groups, Column):
        return F.sqrt(F.lit(T * T) + 2 * F.log((2 * p + 2) * F.greatest(groups, F.lit(1)).cast("double")))
    return math.sqrt(T * T + 2 * math.log((2 * p + 2) * max(groups, 1)))


def probes(result: FitResult) -> DataFrame:
    """A row for each group and probe: square_t, cube_t (0 for the fitted value) and spread_t (0 for terms), before any bound."""
    p = result.schema.p
    fitted = F.col("probe") == p
    known = dots(power_sums(result)).withColumns({"ksq": square_corr(), "kcu": cube_corr(), "share": spread_share()})
    return known.select(
        "group",
        "probe",
        "n",
        "resid_sd",
        "response_sd",
        "first",
        t_of(F.col("ksq"), p).alias("square_t"),
        F.when(fitted, 0.0).otherwise(t_of(F.col("kcu"), p)).alias("cube_t"),
        F.when(fitted, spread_t(F.col("share"))).otherwise(0.0).alias("spread_t"),
    )


def verdicts(result: FitResult, groups: int | None = None) -> DataFrame:
    """group, curved_term (its name, null where the line stands), curved_t, curved_pow, fitted_t, spread_t.

    The bound goes by the number of groups in the same fit, which is counted unless given.
    """
    p = result.schema.p
    groups = result.groups if groups is None else groups
    least = F.lit(bound(p, groups))
    terms = F.array(*[F.lit(t) for t in result.schema.terms])
    fitted = F.col("probe") == p
    # of all |t|, the greatest; of equal ones the earlier term's, and its square before its cube
    larger = F.greatest(F.abs("square_t"), F.abs("cube_t"))
    cubed = F.abs("cube_t") > F.abs("square_t")
    best = F.max_by(F.struct(F.when(cubed, F.col("cube_t")).otherwise(F.col("square_t")).alias("t"), F.when(cubed, 3).otherwise(2).alias("pow"), "probe"), F.when(~fitted, F.struct(larger, -F.col("probe"))))
    quiet = (F.col("n") < LEAST_ROWS) | (F.coalesce(F.col("response_sd") > 0, F.lit(False)) & F.coalesce((F.col("resid_sd") >= 0) & (F.col("resid_sd") < LEAST_SHARE * F.col("response_sd")), F.lit(False)))
    by = probes(result).groupBy("group").agg(best.alias("best"), F.max(F.when(fitted, F.col("square_t"))).alias("f"), F.max(F.when(fitted, F.col("spread_t"))).alias("s"), F.first("n").alias("n"), F.first("resid_sd").alias("resid_sd"), F.first("response_sd").alias("response_sd"), F.first("first").alias("first"))
    curved = ~quiet & (F.abs(F.col("best.t")) >= least)
    return by.select(
        "group",
        F.when(curved, F.element_at(terms, F.col("best.probe") + 1)).alias("curved_term"),
        F.when(curved, F.col("best.t")).otherwise(0.0).alias("curved_t"),
        F.when(curved, F.col("best.pow")).otherwise(0).alias("curved_pow"),
        F.when(~quiet & (F.abs("f") >= least), F.col("f")).otherwise(0.0).alias("fitted_t"),
        F.when(~quiet & (F.col("s") >= least), F.col("s")).otherwise(0.0).alias("spread_t"),
        "first",
    )


def summary(result: FitResult, groups: int | None = None) -> DataFrame:
    """The strongest of each over all groups, the first-seen group of equals."""
    v = verdicts(result, groups)
    curve = F.max_by(F.struct("group", "curved_term", "curved_t", "curved_pow"), F.when(F.col("curved_term").isNotNull(), F.struct(F.abs("curved_t"), -F.col("first"))))
    strongest = lambda c: F.coalesce(F.max_by(c, F.struct(F.abs(c), -F.col("first"))), F.lit(0.0)).alias(c)
    out = v.agg(curve.alias("c"), strongest("fitted_t"), strongest("spread_t"))
    return out.select(F.col("c.group").alias("worst_group"), F.col("c.curved_term").alias("curved_term"), F.coalesce("c.curved_t", F.lit(0.0)).alias("curved_t"), F.coalesce("c.curved_pow", F.lit(0)).alias("curved_pow"), "fitted_t", "spread_t")
