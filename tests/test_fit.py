from __future__ import annotations

import numpy as np
import pytest
from data import ANSCOMBE, CLOSE, LONGLEY, LONGLEY_FIT, LONGLEY_R2, LONGLEY_SD, NORRIS, NORRIS_FIT, NORRIS_R2, NORRIS_SD, ROUTES, WAMPLER

from groupfit.errors import FitError
from groupfit.operators import diagnostics as D
from groupfit.operators.fit import fit
from groupfit.operators.kernels import solve_factor, solve_moments
from groupfit.operators import moments
from groupfit.operators.moments import States, merged, reduced
from groupfit.operators.residuals import residuals
from groupfit.plans.footprint import fit_bytes, model_bytes
from groupfit.plans.report import pinned_notes, report
from groupfit.schema import FitSchema


def state(rows, parts=1, factor=False):
    v = np.array(rows, float)
    some = [reduced(np.zeros(len(v[k::parts]), int), v[k::parts], np.arange(k, len(v), parts), factor) for k in range(parts)]
    return merged(States.joined(some))


def normal(rows, parts=1):
    s = state(rows, parts)
    return solve_moments(int(s.n[0]), s.mean[0], s.c[0])


def factored(rows, parts=1):
    s = state(rows, parts, True)
    return solve_factor(int(s.n[0]), s.r[0], np.append(np.sqrt(s.n[0]), s.norm[0, :-1]), s.lo[0, :-1], s.hi[0, :-1], s.c[0, -1, -1])


def table(spark, rows, terms):
    return spark.createDataFrame(rows, "g string, y double, " + ", ".join(f"{t} double" for t in terms))


SOLVERS = [("normal", 8), ("normal", 0), ("qr", 0)]


@pytest.mark.parametrize("parts", [1, 3, 4])
def test_certified(parts):
    rows = [(x, y) for y, x in NORRIS]
    for solve in (normal, factored):
        f = solve(rows, parts)
        assert np.allclose([f["intercept"], *f["coef"]], NORRIS_FIT, rtol=1e-10)
        assert np.isclose(f["resid_sd"], NORRIS_SD, rtol=1e-9) and np.isclose(f["r2"], NORRIS_R2, rtol=1e-12)
        f = solve([(*r[1:], r[0]) for r in LONGLEY], parts)
        assert np.allclose([f["intercept"], *f["coef"]], LONGLEY_FIT, rtol=1e-8)
        assert np.isclose(f["resid_sd"], LONGLEY_SD, rtol=1e-8) and np.isclose(f["r2"], LONGLEY_R2, rtol=1e-10)


def test_wampler_tells_the_solvers_apart():
    rows = [(*r[2:], r[1]) for r in WAMPLER]
    f, q = normal(rows), factored(rows, 4)
    assert 1e-3 < f["resid_sd"] < 0.2
    assert np.allclose([q["intercept"], *q["coef"]], 1, atol=1e-7) and q["resid_sd"] < 1e-8
    assert np.isclose(q["cond"], 234, rtol=0.02)


def test_nearly_the_same():
    rows = [(*r[2:], r[1]) for r in CLOSE]
    f, q = normal(rows), factored(rows)
    assert np.isclose(f["cond"], 5.34e10, rtol=0.01) and np.allclose(f["coef"], [2, 3], atol=1e-2)
    assert np.allclose(q["coef"], [2, 3], atol=1e-7)


@pytest.mark.parametrize("solve", [normal, factored])
def test_verdicts(solve):
    x = np.arange(12.0)
    z = (x * 5) % 7
    for place in range(3):
        cols = [x, z]
        cols.insert(place, np.full(12, 0.1))
        f = solve(np.column_stack([*cols, 1 + 2 * x - z]), 3)
        assert f["status"][place] == "CONSTANT" and f["pinned"] == 1 and f["coef"][place] == 0
        assert np.allclose(np.delete(f["coef"], place), [2, -1]) and f["df"] == 9
    f = solve(np.column_stack([x, 2 * x, 1 + 3 * x]))
    assert f["status"] == ["FITTED", "COLLINEAR"] and np.allclose(f["coef"], [3, 0]) and np.isclose(f["r2"], 1)
    f = solve([(1.0, 1.0, 4.0)])
    assert f["pinned"] == 2 and f["intercept"] == 4 and f["df"] == 0 and f["resid_sd"] is None
    f = solve(np.column_stack([x, np.full(12, 5.0)]), 4)
    assert f["r2"] is None and f["r2_status"] == "FLAT_Y" and abs(f["intercept"] - 5) < 1e-12


def test_magnitudes():
    x = np.arange(6.0)
    z = (x * x) % 5
    for scale in (1, 1e153, 1e154, 1e200):
        f = factored(np.column_stack([x, z * scale, 1 + x + z]))
        assert f["pinned"] == 0 and f["df"] == 3
    assert normal(np.column_stack([z, x * 1e160, x]))["failure"] == "COLUMN_OVERFLOW"
    y = np.where(x % 2 == 0, 1e160, -1e160)
    assert normal(np.column_stack([x, y]))["failure"] == factored(np.column_stack([x, y]))["failure"] == "RESPONSE_OVERFLOW"
    units = np.column_stack([1e5 + 2e4 * np.arange(40), np.arange(40) % 2])
    f = normal(np.column_stack([units, 1 + 2e-6 * units[:, 0] + 5 * units[:, 1]]), 5)
    assert np.allclose(f["coef"], [2e-6, 5], rtol=1e-9)


@pytest.mark.parametrize("solver,sql_terms", SOLVERS)
def test_routes(spark, solver, sql_terms):
    df = table(spark, ROUTES, ["km", "stops"])
    r = fit(df, solver=solver, sql_terms=sql_terms).check()
    got = {x["group"]: (x["intercept"], x["km"], x["stops"]) for x in r.wide.collect()}
    assert np.allclose([got[g] for g in ("city", "suburb", "highway")], [(5, 3, 2), (4, 2, 1.5), (8, 1, 5)])
    s = {x["group"]: x for x in r.stats.collect()}
    assert s["city"]["df"] == 3
    if solver == "normal":
        assert s["city"]["resid_sd_is_bound"]
        assert np.allclose([s[g]["resid_sd"] for g in ("city", "suburb", "highway")], [6.99383906911e-07, 4.73703684717e-07, 3.82817762454e-07], rtol=1e-6)
        assert np.isclose(s["city"]["cond"], 1.02103, rtol=1e-5)
    pool = fit(df, solver=solver, sql_terms=sql_terms, group="*").fits.collect()[0]
    assert np.allclose([pool["intercept"], *pool["coef"]], [17 / 3, 2, 17 / 6]) and np.isclose(pool["r2"], 0.8159, atol=5e-5) and pool["df"] == 15


@pytest.mark.parametrize("solver,sql_terms", SOLVERS)
def test_partitions_do_not_matter(spark, solver, sql_terms):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 3}", float(v[0]), *map(float, v[1:])) for i, v in enumerate(rng.normal(100, 3, (600, 4)))]
    df = table(spark, rows, ["a", "b", "c"])
    got = [sorted((r["group"], r["intercept"], *r["coef"], r["r2"], r["resid_sd"]) for r in fit(df.repartition(n), solver=solver, sql_terms=sql_terms).fits.collect()) for n in (1, 4, 7)]
    for other in got[1:]:
        assert np.allclose([x[1:] for x in got[0]], [x[1:] for x in other], rtol=1e-10)


def test_golden_small(spark):
    r = fit(table(spark, [("A", float(a), float(b), float(b)) for a, b in ((10, 1), (20, 1), (5, 0), (7, 0), (12, 1))], ["night", "headlights"]))
    f = r.fits.collect()[0]
    assert np.allclose([f["intercept"], *f["coef"]], [6, 8, 0]) and f["status"] == ["FITTED", "COLLINEAR"] and np.isclose(f["r2"], 0.5697, atol=5e-5) and np.isclose(f["resid_sd"], 4.397, atol=5e-4) and f["df"] == 3
    assert pinned_notes(r).collect()[0]["note"] == "# pinned A: collinear headlights"
    f = fit(table(spark, [("A", 1.0, 0.0, 0.0), ("A", 4.0, 1.0, 0.0), ("A", 7.0, 0.0, 1.0)], ["km", "stops"]))
    one = f.check().fits.collect()[0]
    assert one["df"] == 0 and one["resid_sd"] is None and np.isclose(one["cond"], 4 / 3)
    assert any("no residual degrees" in line for line in report(f))


def test_anscombe_and_curve(spark):
    rows = [(g, float(y), float(x)) for g, (xs, ys) in ANSCOMBE.items() for x, y in zip(xs, ys, strict=True)]
    r = fit(table(spark, rows, ["x"]))
    v = {x["group"]: x for x in D.verdicts(r).collect()}
    assert [g for g in v if v[g]["curved_term"]] == ["II"] and np.isclose(v["II"]["curved_t"], -2219.2, atol=0.1)
    assert np.isclose(D.bound(1, 4), 4.22, atol=0.005)
    assert abs(r.summary.first()["max_sigma"] - 1.237) < 5e-4 and all(x["df"] == 9 for x in r.stats.collect())
    s = D.summary(r).first()
    assert s["worst_group"] == "II" and s["curved_pow"] == 2
    curve = fit(table(spark, [("A", 10.0 + x * x, float(x)) for x in range(-6, 7)], ["x"]))
    c = D.verdicts(curve).first()
    assert c["curved_t"] == 9999 and c["curved_pow"] == 2
    assert any("square" in line for line in report(curve, D.summary(curve).first().asDict()))


def test_diagnostics_do_not_move_with_offsets(spark):
    for power in (2, 3):
        got = []
        for offset in (0.0, 1e6, 1e9):
            rows = [("A", (0.05 * i) ** power + ((7919 * (i + 60) % 23) - 11) * 0.1, offset + 0.05 * i) for i in range(-60, 61)]
            x = D.verdicts(fit(table(spark, rows, ["x"])), 1).first()
            got.append(x["curved_t"])
            assert x["curved_pow"] == power
        assert np.allclose(got, got[0], rtol=0.01)


def test_spread(spark):
    rows = [("A", 3.0 * i + (i * (0.2 if i % 2 else -0.2)), float(i)) for i in range(1, 200)]
    assert D.verdicts(fit(table(spark, rows, ["x"]))).first()["spread_t"] > 5
    rows = [("A", 3.0 * i + (0.2 if i * 37 % 11 > 5 else -0.2), float(i)) for i in range(1, 200)]
    assert D.verdicts(fit(table(spark, rows, ["x"]))).first()["spread_t"] == 0


def test_residuals_and_summary(spark):
    r = fit(table(spark, [("A", float(i % 5), float(i)) for i in range(20)], ["x"]))
    got = residuals(r).collect()
    assert len(got) == 20 and abs(sum(x["residual"] for x in got)) < 1e-9
    s = r.summary.first()
    assert s["groups"] == 1 and s["rows"] == 20 and s["min_df"] == 18


def test_wide(spark):
    rows = [("A", 5.0 + sum(0.25 * (k + 1) * (j == k) for k in range(40)), *[float(j == k) for k in range(40)]) for j in range(60)]
    f = fit(table(spark, rows, [f"t{k}" for k in range(40)])).fits.collect()[0]
    assert np.allclose(f["coef"], [0.25 * (k + 1) for k in range(40)], atol=1e-6)


def test_schema_and_footprint():
    s = FitSchema.of(["g", "minutes", "km", "stops"], "STOPS")
    assert s.response == "stops" and s.terms == ("minutes", "km") and "2 columns are terms" in s.reading()
    assert fit_bytes(24) == 8704 and fit_bytes(35) == 15568 and model_bytes() == 2064
    for bad in (["g", "y"], ["g", "y", ""], ["g", "y", "x" * 64], ["g", "y", "a", "A"], ["g", "y", *[f"t{k}" for k in range(257)]]):
        with pytest.raises(FitError):
            FitSchema.of(bad)


def test_a_named_group_still_needs_all_rows(spark):
    df = table(spark, [("A", 1.0, 1.0), ("A", 2.0, 2.0), ("A", 4.0, 3.0), ("B", 1.0, None)], ["x"])
    with pytest.raises(FitError) as e:
        fit(df, group="A").check()
    assert e.value.code == "NOT_FINITE"
    assert fit(df.where("g = 'A'"), group="A").check().fits.count() == 1


def test_many_groups_in_small_pieces(spark, monkeypatch):
    """States handed on early, pieces of few rows, and groups that span batches come to the same lines."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(moments, "CHUNK", 4000)
    monkeypatch.setattr(moments, "HELD", 3000)
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100.0
    df = spark.range(6000).select(F.when(F.col("id") % 401 == 400, None).otherwise((F.col("id") % 401).cast("string")).alias("g"), noise(0).alias("y"), noise(1).alias("a"), (1e6 + noise(2)).alias("b")).repartition(5)
    by = {}
    for name, how in (("sql", {"sql_terms": 8}), ("tasks", {"sql_terms": 0}), ("qr", {"solver": "qr"})):
        by[name] = {r["group"]: r for r in fit(df, **how).fits.collect()}
    assert len(by["sql"]) == 401
    for name in ("tasks", "qr"):
        for g, want in by["sql"].items():
            got = by[name][g]
            assert got["rows"] == want["rows"] and got["df"] == want["df"]
            assert np.allclose([got["intercept"], *got["coef"]], [want["intercept"], *want["coef"]], rtol=1e-5, atol=1e-7)
    assert fit(df.limit(0), sql_terms=0).fits.count() == 0


def test_power_sums_of_tasks_and_of_spark_agree(spark, monkeypatch):
    from pyspark.sql import functions as F

    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100.0
    df = spark.range(2000).select((F.col("id") % 7).cast("string").alias("g"), noise(0).alias("y"), *[noise(k).alias(f"x{k}") for k in range(1, 5)]).repartition(3)
    sums = {}
    for name, most, held in (("spark", 9, 1 << 26), ("tasks", 0, 1 << 26), ("flushed", 0, 1000)):
        monkeypatch.setattr(D, "SQL_PROBES", most)
        monkeypatch.setattr(D, "HELD", held)
        sums[name] = {(r["group"], r["probe"]): r for r in D.power_sums(fit(df)).collect()}
    assert len(sums["spark"]) == 35
    for name in ("tasks", "flushed"):
        for key, want in sums["spark"].items():
            got = sums[name][key]
            assert got["n"] == want["n"] and got["first"] == want["first"] and got["resid_sd"] == pytest.approx(want["resid_sd"])
            assert np.allclose([got[k] for k in D.SUMS], [want[k] for k in D.SUMS], rtol=1e-9, atol=1e-6 * abs(want["su6"]))
