from __future__ import annotations

import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groupfit.errors import FitError
from groupfit.functions.numbers import check_scale, parse_number, printed, round_half_away, significant
from groupfit.operators.fit import fit
from groupfit.operators.score import named_case, score_named, score_rows, score_text, unknown_groups
from groupfit.plans.progress import Progress, due, duration
from groupfit.plans.sinks import model_lines, residual_lines, stats_lines, write_text
from groupfit.operators.residuals import residuals
from groupfit.sources.text import cases_from, read_model, read_training, training_from, trims_from
from groupfit.streaming.fit import score_stream, start_fit
from groupfit.schema import FitSchema


def lines(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "row_id long, value string")


def reason(spark, *rows):
    with pytest.raises(FitError) as e:
        training_from(lines(spark, *rows)).check()
    return str(e.value)


HEAD = "g,y,a,b"


def test_refusals(spark):
    for row, fragment in [
        ("A,1,,2", "a empty"), ("A,1,NA,2", "a 'NA'"), ("A,1,red,2", "no encoding for a category name"), ("A,1,2", "it has 3 fields and the header names 4"),
        ('"A",1,2,3', "quoted"), ('A,"1",2,3', "quoted"), ("A',1,2,3", "quoted"), ('A,1,"1,5",2', "the row contains a quote"), ("A;1;1;2", "does have semicolons"),
        ("A,high,1,2", "y 'high'"), ("#B,9,9,9", "shape of a data row"), ("A,1\0,2,3", "LINE_NUL"), ("A,1,2,3\rB,1,2,3", "LINE_CR"), ("A,0x10,1,2", "BAD_RESPONSE"),
        ("A,1e400,1,2", "BAD_RESPONSE"), ("A,nan,1,2", "BAD_RESPONSE"), (",1,2,3", "BAD_GROUP"), ("g" * 32 + ",1,2,3", "BAD_GROUP"),
    ]:
        assert fragment in reason(spark, HEAD, "A,1,2,3", row), row
    good = training_from(lines(spark, "﻿# a note", "", HEAD, "A,1e3,1e-320, 2 \r", "   ", "# a note", "O'Brien,1,2,3")).check()
    assert [tuple(r)[1:] for r in good.rows.orderBy("row_id").collect()] == [("A", 1000.0, [1e-320, 2.0]), ("O'Brien", 1.0, [2.0, 3.0])]
    for rows, code in (((), "NO_HEADER"), (("g;y;a",), "HEADER_SEMICOLON"), (("g,y",), "HEADER_TOO_NARROW"), (("g,y,a,A",), "BAD_TERMS")):
        with pytest.raises(FitError) as e:
            training_from(lines(spark, *rows))
        assert e.value.code == code
    with pytest.raises(FitError) as e:
        training_from(lines(spark, HEAD, "A,1,2,3"), response="outcome")
    assert "has no column" in str(e.value)


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"# prose\r\ng,minutes,km,stops\r\nA,5,0,0\r\nA,30,10,0\r\nA,9.5,0,3\r\nA,34.5,10,3")
    t = read_training(spark, str(tmp_path / "t.csv")).check()
    r = fit(t.table(), t.schema).check()
    write_text(model_lines(r), str(tmp_path / "m"))
    text = spark.read.text(str(tmp_path / "m")).collect()
    assert [x[0] for x in text] == ["# response: minutes", "group,intercept,km,stops", "A,5,2.5,1.5"]
    m = read_model(spark, str(tmp_path / "m"))
    assert m.response == "minutes" and m.listing() == ["2 terms, 1 groups", "it predicts: minutes", "1. km", "2. stops"]
    assert [x[2] for x in model_lines(fit(t.table(), t.schema, group="*")).orderBy("ord", "part").collect()][0] == "group,intercept,km,stops"
    assert [x["line"] for x in stats_lines(r).orderBy("ord").collect()][0] == "group,rows,df,r2,resid_sd,cond,pinned"
    assert residual_lines(residuals(r)).count() == 4
    (tmp_path / "cr.csv").write_bytes(b"g,y,a\rA,1,2\r")
    with pytest.raises(FitError) as e:
        read_training(spark, str(tmp_path / "cr.csv"))
    assert e.value.code == "LINE_CR"
    with pytest.raises(FitError) as e:
        read_training(spark, str(tmp_path / "none.csv"))
    assert e.value.code == "NOT_FOUND"


def model(spark):
    return spark.createDataFrame([("001", 6.4832, [6.0308, 7.4471]), ("B", 3.0, [1.5e-6, 0.0])], "group string, intercept double, coef array<double>")


def test_scores(spark):
    cases = spark.createDataFrame([(0, "001", [1.0, 1.0]), (1, "B", [1e6, 0.0]), (2, "Z", [0.0, 0.0])], "id int, group string, x array<double>")
    trims = trims_from(lines(spark, "group,trim_addition", "001,1", "# 001,7", "zz,5", "001,26.5528"))
    got = [x["line"] for x in score_text(score_rows(cases, model(spark), trims)).orderBy("id").collect()]
    assert got == ["001 prediction=19.9611 trim=46.5", "B prediction=4.5000 trim=4.5"]
    assert [x["line"] for x in score_text(score_rows(cases, model(spark))).orderBy("id").collect()] == ["001 prediction=19.9611", "B prediction=4.5000"]
    assert score_rows(cases, model(spark), trims_from(lines(spark, "zz,5"))).where("trim is not null").count() == 0
    assert [x["id"] for x in unknown_groups(cases, model(spark)).collect()] == [2]
    named = spark.createDataFrame([(0, "001", ["Cardio=1", "ICU=0", "icu=1"]), (1, "001", ["x=1"]), (2, "B", ["cardio"]), (3, "B", ["cardio=0x1"])], "id int, group string, assignments array<string>")
    assert [(x["id"], x["prediction"]) for x in score_named(named, model(spark), ["cardio", "icu"]).collect()] == [(0, 19.9611)]
    assert [x[0] for x in named.orderBy("id").select(named_case(F.col("assignments"), ["cardio", "icu"])[1]).collect()] == [None, "UNKNOWN_TERM", "NOT_ASSIGNMENT", "BAD_VALUE"]
    for bad in ("abc", "3.9", "", -1, 12, None):
        with pytest.raises(FitError):
            check_scale(bad)
    for rows in (("x,1", "a,b,c"), ("001,x", "001,y"), ()):
        with pytest.raises(FitError):
            trims_from(lines(spark, *rows))


def test_case_lines(spark):
    good, bad = cases_from(lines(spark, "A,1,2", "", "#A,1,2", "  ", "A,1,x", "﻿B,3,4\r"), ["a", "b"])
    assert [tuple(r)[1:] for r in good.orderBy("row_id").collect()] == [("A", [1.0, 2.0]), ("B", [3.0, 4.0])]
    assert [r["refusal"]["code"] for r in bad.orderBy("row_id").collect()] == ["FIELD_COUNT", "BAD_TERM"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(300).selectExpr("concat('g', id % 3) as g", "1.0 + 2.0 * id + id % 7 as y", "cast(id as double) as x", "cast(id % 5 as double) as z")
    rows.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = []
    schema = FitSchema.of(["g", "y", "x", "z"])
    start_fit(stream, schema, lambda fits, batch: got.append({r["group"]: (r["intercept"], *r["coef"]) for r in fits.collect()}), str(tmp_path / "c")).awaitTermination()
    batch = {r["group"]: (r["intercept"], *r["coef"]) for r in fit(rows, schema).fits.collect()}
    assert len(got) == 3 and all(abs(a - b) < 1e-9 for g in batch for a, b in zip(batch[g], got[-1][g], strict=True))
    for k, (solver, terms) in enumerate((("normal", 0), ("qr", 8))):
        wide = []
        start_fit(stream, schema, lambda fits, batch, wide=wide: wide.append({r["group"]: (r["intercept"], *r["coef"]) for r in fits.collect()}), str(tmp_path / f"w{k}"), solver=solver, sql_terms=terms).awaitTermination()
        assert len(wide) == 3 and all(abs(a - b) < 1e-8 for g in batch for a, b in zip(batch[g], wide[-1][g], strict=True))
    m = fit(rows, schema).model
    m = spark.createDataFrame(m.collect(), m.schema)
    out = score_stream(stream.selectExpr("g as group", "array(x, z) as x"), m)
    out.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("scored").count() == 300
    with pytest.raises(FitError) as e:
        residuals(fit(stream, schema))
    assert e.value.code == "RESIDUALS_NEED_FILE"


def test_rounding_and_digits(spark):
    got = spark.createDataFrame([(2.5,), (-2.5,), (1.005,), (0.49999999999999994,)], "v double").select(round_half_away(F.col("v"), 0), round_half_away(F.col("v"), 2)).collect()
    assert [tuple(r) for r in got] == [(3.0, 2.5), (-3.0, -2.5), (1.0, 1.0), (0.0, 0.5)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(), min_size=1, max_size=60), st.lists(st.integers(10**11, 10**12 - 1), min_size=1, max_size=60), st.integers(-30, 20))
def test_digits_are_those_of_c(spark, values, ties, power):
    values = [*values, *(float(f"{n}5e{power}") for n in ties), -0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", significant(F.col("v")).alias("t"), significant(F.col("v"), 17).alias("all"), printed(F.col("v"), "%.6f").alias("six")).withColumn("back", parse_number(F.col("all"))).collect()
    for r, v in zip(got, values, strict=True):
        assert (r["t"], r["six"]) == ("%.12g" % v, "%.6f" % v)
        assert v - v != 0 or r["back"] == v or abs(v) < 1e-300


def test_names_fold_ascii_alone(spark):
    m = spark.createDataFrame([("A", 1.0, [2.0, 3.0])], "group string, intercept double, coef array<double>")
    cases = spark.createDataFrame([(0, "A", ["Éclair=2", "KM=1"]), (1, "A", ["éclair=2"])], "id int, group string, assignments array<string>")
    assert [(r["id"], r["prediction"]) for r in score_named(cases, m, ["Éclair", "km"]).collect()] == [(0, 8.0)]


def test_long_lines_and_files(spark, tmp_path):
    wide = "﻿g,y," + ",".join(f"x{k}" for k in range(200)) + " " * 20_000
    rows = lines(spark, wide, "A,1" + ",2" * 200)
    with pytest.raises(FitError) as e:
        training_from(rows)
    assert e.value.code == "LINE_TOO_LONG"
    assert len(training_from(rows, max_line_bytes=10**6).check().schema.terms) == 200
    for name, text in (("a b.csv", "g,y,x\nZ,1,2\nZ,2,5\n"), ("b.csv", "M,4,1\nM,2,7\nM,3,3\n"), ("c.csv", "A,1,2\nA,4,4\n")):
        (tmp_path / name).write_text(text)
    read = read_training(spark, [str(tmp_path / n) for n in ("c.csv", "b.csv", "a b.csv")])
    order = [r["group"] for r in fit(read).fits.orderBy("first").collect()]
    assert order == ["Z", "M", "A"]


def test_progress(spark):
    assert [due(59, 59), due(60, 60), due(90, 30), due(121, 61)] == [False, True, False, True]
    assert [duration(s) for s in (12, 252, 3852)] == ["12s", "4m 12s", "1h 4m 12s"]
    out = io.StringIO()
    with Progress(spark, "fitting", out, 0.01) as p:
        spark.range(1000).repartition(8).count()
    assert out.getvalue() == "" and p.line(61).startswith("fitting: ") and p.line(61).endswith("tasks/s")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="A,1.5e-+ #\"'\txnaif;", max_size=12), min_size=1, max_size=80))
def test_whatever_is_read_is_finite(spark, rows):
    lines_ = spark.createDataFrame([(-1, "g,y,x"), *enumerate(rows)], "row_id long, value string")
    got = training_from(lines_).rows.collect()
    for r in got:
        assert r["group"] and all(v is not None and abs(v) < float("inf") for v in [r["y"], *r["x"]])
