"""Registered queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from .errors import FitError
from .functions.numbers import parse_number, printed, round_half_away, significant
from .operators import diagnostics as D
from .operators.fit import FitResult, fit
from .operators.residuals import residuals
from .operators.score import named_case, score_named, score_rows, score_text, unknown_groups
from .plans.footprint import fit_bytes, footprint, model_bytes
from .plans.report import pinned_notes, report
from .plans.sinks import model_lines, residual_lines, stats_lines, write_text
from .schema import FitSchema
from .sources.scratch import scratch
from .sources.text import cases_from, fields, logical_lines, model_from, parse_rows, read_model, read_training, training_from, trims_from
from .streaming.fit import score_stream, start_fit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c * float(10**digits), 0) / float(10**digits) + F.lit(0.0)


def coefs(result: FitResult) -> DataFrame:
    """group, rows and rounded b0..bp."""
    return result.fits.select("group", "rows", rnd(F.col("intercept")).alias("b0"), *[rnd(F.col("coef")[k]).alias(f"b{k + 1}") for k in range(result.schema.p)])


LINES = {"y": "l_extendedprice", "x1": "l_quantity", "x2": "l_discount", "x3": "l_tax"}


def priced(spark: SparkSession, sf_dir: str, p: int, group: str = "l_returnflag") -> DataFrame:
    """A training table of lineitem: g, y, x1..xp."""
    return table(spark, sf_dir, "lineitem").select(F.expr(group).alias("g"), *[F.col(v).alias(k) for k, v in list(LINES.items())[: p + 1]])


def priced_sql(p: int, group: str = "l_returnflag") -> str:
    return f"SELECT {group} AS g, " + ", ".join(f"{v} AS {k}" for k, v in list(LINES.items())[: p + 1]) + " FROM lineitem"


BOTH = "concat(l_returnflag, '|', l_linestatus)"


@query(O.fitted(priced_sql(1, BOTH), 1))
def fit_groups_1term(spark, sf_dir):
    return coefs(fit(priced(spark, sf_dir, 1, BOTH)))


@query(O.fitted(priced_sql(2), 2))
def fit_groups_2term(spark, sf_dir):
    return coefs(fit(priced(spark, sf_dir, 2)))


@query(O.fitted(priced_sql(3, BOTH), 3))
def fit_groups_3term(spark, sf_dir):
    return coefs(fit(priced(spark, sf_dir, 3, BOTH)))


@query(O.fitted(priced_sql(3, BOTH), 3))
def fit_groups_by_tasks(spark, sf_dir):
    return coefs(fit(priced(spark, sf_dir, 3, BOTH), sql_terms=0))


@query(O.fitted(priced_sql(2, "'*'"), 2))
def fit_pooled(spark, sf_dir):
    return coefs(fit(priced(spark, sf_dir, 2), group="*"))


@query(O.fitted(priced_sql(2), 2, "WHERE g = 'R'"))
def fit_single_group(spark, sf_dir):
    return coefs(fit(priced(spark, sf_dir, 2), group="R"))


@query(O.fitted("SELECT o_orderstatus AS g, o_totalprice AS y, o_custkey::DOUBLE AS x1, (year(o_orderdate) - 1995)::DOUBLE AS x2 FROM orders", 2))
def fit_named_response(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").cast("double").alias("o_custkey"), (F.year("o_orderdate") - 1995).cast("double").alias("o_year"), "o_totalprice")
    return coefs(fit(orders, FitSchema.of(orders.columns, "O_TotalPrice")))


@query(O.fitted(priced_sql(2), 2))
def fit_qr_2term(spark, sf_dir):
    return coefs(fit(priced(spark, sf_dir, 2), solver="qr"))


STATS = ", ".join(["g AS \"group\"", "n AS rows", "df", O.rounded("r2", 9, "r2"), O.rounded("sd", 5, "resid_sd"), "false AS resid_sd_is_bound", "0 AS pinned"])


def stats(result: FitResult) -> DataFrame:
    s = result.stats
    return s.select("group", "rows", "df", rnd(F.col("r2"), 9).alias("r2"), rnd(F.col("resid_sd"), 5).alias("resid_sd"), "resid_sd_is_bound", "pinned")


@query(f"WITH {O.with_stats(priced_sql(2), 2)} SELECT {STATS} FROM st")
def stats_table(spark, sf_dir):
    return stats(fit(priced(spark, sf_dir, 2)))


@query(f"WITH {O.with_stats(priced_sql(2), 2)} SELECT {STATS} FROM st")
def fit_qr_stats(spark, sf_dir):
    return stats(fit(priced(spark, sf_dir, 2), solver="qr"))


@query(f"WITH {O.solved(priced_sql(2), 2)} SELECT g AS \"group\", {O.rounded('1 / (1 - s12 * s12 / (s11 * s22))', 9, 'cond')} FROM b")
def cond_2term(spark, sf_dir):
    return fit(priced(spark, sf_dir, 2)).stats.select("group", rnd(F.col("cond"), 9).alias("cond"))


def pinned(spark, sf_dir) -> FitResult:
    train = priced(spark, sf_dir, 1).select("g", "y", F.lit(7.0).alias("seven"), F.col("x1").alias("quantity"), (2 * F.col("x1")).alias("double_quantity"))
    return fit(train)


def verdicts(result: FitResult) -> DataFrame:
    f = result.fits
    return f.select("group", rnd(F.col("intercept")).alias("b0"), *[rnd(F.col("coef")[k]).alias(f"b{k + 1}") for k in range(result.schema.p)], F.array_join("status", ",").alias("verdicts"), "df", "pinned")


PINNED = O.solved(priced_sql(1), 1)


@query(f"WITH {PINNED} SELECT g AS \"group\", {O.rounded('b0', 6, 'b0')}, 0.0::DOUBLE AS b1, {O.rounded('b1', 6, 'b2')}, 'CONSTANT,FITTED' AS verdicts, n - 2 AS df, 1 AS pinned FROM b")
def fit_pinned_constant(spark, sf_dir):
    return verdicts(fit(priced(spark, sf_dir, 1).select("g", "y", F.lit(0.1).alias("tenth"), "x1")))


@query(f"WITH {PINNED} SELECT g AS \"group\", {O.rounded('b0', 6, 'b0')}, {O.rounded('b1', 6, 'b1')}, 0.0::DOUBLE AS b2, 'FITTED,COLLINEAR' AS verdicts, n - 2 AS df, 1 AS pinned FROM b")
def fit_pinned_collinear(spark, sf_dir):
    return verdicts(fit(priced(spark, sf_dir, 1).select("g", "y", "x1", (2 * F.col("x1")).alias("twice"))))


@query(f"WITH {PINNED} SELECT g AS \"group\", {O.rounded('b0', 6, 'b0')}, 0.0::DOUBLE AS b1, {O.rounded('b1', 6, 'b2')}, 0.0::DOUBLE AS b3, 'CONSTANT,FITTED,COLLINEAR' AS verdicts, n - 2 AS df, 2 AS pinned FROM b")
def fit_qr_pinned(spark, sf_dir):
    train = priced(spark, sf_dir, 1).select("g", "y", F.lit(7.0).alias("seven"), "x1", (2 * F.col("x1")).alias("twice"))
    return verdicts(fit(train, solver="qr"))


@query("SELECT DISTINCT l_returnflag AS \"group\", '# pinned ' || l_returnflag || ': constant seven collinear double_quantity' AS note FROM lineitem")
def pinned_notes_table(spark, sf_dir):
    return pinned_notes(pinned(spark, sf_dir))


@query("SELECT l_returnflag AS \"group\", 5.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, NULL::DOUBLE AS r2, 'FLAT_Y' AS r2_status, NULL::DOUBLE AS resid_sd, count(*) - 2 AS df FROM lineitem GROUP BY 1")
def fit_flat_response(spark, sf_dir):
    train = priced(spark, sf_dir, 1).select("g", F.lit(5.0).alias("five"), "x1")
    return fit(train).fits.select("group", rnd(F.col("intercept")).alias("b0"), rnd(F.col("coef")[0]).alias("b1"), "r2", "r2_status", "resid_sd", "df")


@query(f"""WITH m AS (SELECT l_orderkey::VARCHAR AS g, count(*) AS n, min(l_quantity) = max(l_quantity) AS still, covar_pop(l_quantity, l_quantity) AS sxx, covar_pop(l_quantity, l_extendedprice) AS sxy, covar_pop(l_extendedprice, l_extendedprice) AS syy FROM lineitem GROUP BY 1),
b AS (SELECT *, CASE WHEN still THEN n - 1 ELSE n - 2 END AS df, CASE WHEN still THEN syy ELSE syy - sxy * sxy / sxx END * n AS sse FROM m)
SELECT g AS "group", n AS rows, df, still::INTEGER AS pinned, CASE WHEN df > 0 AND syy > 0 THEN {O.rounded('sqrt(sse / df)', 2)} END AS resid_sd, CASE WHEN still THEN 'CONSTANT' ELSE 'FITTED' END AS verdict FROM b""")
def fit_low_df(spark, sf_dir):
    """A group for each order: one to seven rows."""
    train = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("g"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"))
    return fit(train).fits.select("group", "rows", "df", "pinned", rnd(F.col("resid_sd"), 2).alias("resid_sd"), F.col("status")[0].alias("verdict"))


@query(
    f"WITH {O.with_stats(priced_sql(2), 2)} SELECT count(*) AS groups, sum(n)::BIGINT AS rows, 0::BIGINT AS pinned, min(df) AS min_df, {O.rounded('max(1 / (1 - s12 * s12 / (s11 * s22)))', 9, 'max_condition')}, {O.rounded('min(r2)', 9, 'min_r2')}, {O.rounded('max(sd)', 5, 'max_sigma')}, 0::BIGINT AS groups_flat_y, 0::BIGINT AS groups_r2_lost, false AS sigma_is_bound FROM st"
)
def fit_summary(spark, sf_dir):
    s = fit(priced(spark, sf_dir, 2)).summary
    return s.withColumns({"max_condition": rnd(F.col("max_condition"), 9), "min_r2": rnd(F.col("min_r2"), 9), "max_sigma": rnd(F.col("max_sigma"), 5)})


@query(f"WITH {O.solved(priced_sql(2), 2)} SELECT src.g AS \"group\", y AS observed, {O.rounded('b0 + b1 * x1 + b2 * x2', 4, 'predicted')}, {O.rounded('y - (b0 + b1 * x1 + b2 * x2)', 4, 'residual')} FROM src JOIN b ON src.g = b.g")
def residual_rows(spark, sf_dir):
    r = residuals(fit(priced(spark, sf_dir, 2)))
    return r.select("group", "observed", rnd(F.col("predicted"), 4).alias("predicted"), rnd(F.col("residual"), 4).alias("residual"))


PART_SQL = "SELECT p_brand AS g, p_retailprice AS y, p_size::DOUBLE AS x1 FROM part"
EVENT_SQL = "SELECT event_type AS g, value AS y, hour(ts)::DOUBLE AS x1 FROM events"


def sized(spark, sf_dir) -> FitResult:
    return fit(table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x1")))


def timed(spark, sf_dir) -> FitResult:
    return fit(table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.col("value").alias("y"), F.hour("ts").cast("double").alias("x1")))


#: Power sums are published in units that leave nine digits or so.
UNITS = {"su2": 1, "su3": 10, "su4": 1e3, "su5": 1e4, "su6": 1e6, "sru2": 1e3, "sru3": 1e4, "sr2": 1e3, "sr4": 1e9, "sw1": 1e6, "sw2": 1e8, "sa1": 10, "sau1": 100}
#: Of the fitted value, whose powers are larger, and first powers, which are 0 but for rounding.
FITTED_UNITS = {"su2": 1e4, "su4": 1e10, "sru2": 1e7, "sr2": 1e3, "sr4": 1e9, "sw1": 1e8, "sw2": 1e12, "sa1": 10, "sau1": 1e4}
FIRST_UNITS = {"su1": 1e4, "sr1": 1e4, "sru1": 1e7}


@query(f"WITH {O.with_sums(PART_SQL)} SELECT g AS \"group\", n, " + ", ".join(O.rounded(f"{k} / {u:g}", 2, k) for k, u in (UNITS | FIRST_UNITS).items()) + " FROM sums WHERE probe = 0")
def diag_power_sums(spark, sf_dir):
    return D.power_sums(sized(spark, sf_dir)).where("probe = 0").select("group", "n", *[rnd(F.col(k) / float(u), 2).alias(k) for k, u in (UNITS | FIRST_UNITS).items()])


@query(f"WITH {O.with_sums(EVENT_SQL)} SELECT g AS \"group\", n, " + ", ".join(O.rounded(f"{k} / {u:g}", 2, k) for k, u in FITTED_UNITS.items()) + " FROM sums WHERE probe = 1")
def diag_power_sums_fitted(spark, sf_dir):
    return D.power_sums(timed(spark, sf_dir)).where("probe = 1").select("group", "n", *[rnd(F.col(k) / float(u), 2).alias(k) for k, u in FITTED_UNITS.items()])


def probe(name: str, at: int, sql: str = PART_SQL) -> str:
    return f"WITH {O.with_probes(sql)} SELECT g AS \"group\", n, {O.rounded(name, 5, name)} FROM t WHERE probe = {at}"


@query(probe("square_t", 0))
def diag_curvature_sq(spark, sf_dir):
    return D.probes(sized(spark, sf_dir)).where("probe = 0").select("group", "n", rnd(F.col("square_t"), 5).alias("square_t"))


@query(probe("cube_t", 0, EVENT_SQL))
def diag_curvature_cu(spark, sf_dir):
    return D.probes(timed(spark, sf_dir)).where("probe = 0").select("group", "n", rnd(F.col("cube_t"), 5).alias("cube_t"))


@query(probe("square_t", 1, EVENT_SQL).replace("AS square_t FROM t WHERE", "AS fitted_t FROM t WHERE"))
def diag_fitted(spark, sf_dir):
    return D.probes(timed(spark, sf_dir)).where("probe = 1").select("group", "n", rnd(F.col("square_t"), 5).alias("fitted_t"))


@query(probe("spread_t", 1, EVENT_SQL))
def diag_spread(spark, sf_dir):
    return D.probes(timed(spark, sf_dir)).where("probe = 1").select("group", "n", rnd(F.col("spread_t"), 5).alias("spread_t"))


@query(f"SELECT {O.rounded('sqrt(12.25 + 2 * ln(4 * count(DISTINCT p_brand)))', 9, 'bound')} FROM part")
def diag_bound(spark, sf_dir):
    return sized(spark, sf_dir).fits.agg(rnd(D.bound(1, F.count("*")), 9).alias("bound"))


#: A parabola under the line: 40 rows a brand, so that verdicts fire.
BENT_SQL = "SELECT p_brand AS g, 100 + p_size * 3.0 + CASE WHEN p_brand < 'Brand#3' THEN 0.2 * (p_size - 25) * (p_size - 25) ELSE 0 END + (p_partkey * 7919 % 23 - 11) * 0.5 AS y, p_size::DOUBLE AS x1 FROM part"
STRONG = "CASE WHEN abs(cube_t) > abs(square_t) THEN cube_t ELSE square_t END"
VERDICT = f"""WITH {O.with_probes(BENT_SQL)},
v AS (SELECT g, max(CASE WHEN probe = 0 THEN {STRONG} END) AS best, max(CASE WHEN probe = 0 THEN CASE WHEN abs(cube_t) > abs(square_t) THEN 3 ELSE 2 END END) AS pow,
  max(CASE WHEN probe = 1 THEN square_t END) AS f, max(CASE WHEN probe = 1 THEN spread_t END) AS s, max(n) AS n, sqrt(12.25 + 2 * ln(4 * count(*) OVER ())) AS bound FROM t GROUP BY g),
w AS (SELECT g, n >= 10 AND abs(best) >= bound AS curved, best, pow, CASE WHEN n >= 10 AND abs(f) >= bound THEN f ELSE 0 END AS f, CASE WHEN n >= 10 AND s >= bound THEN s ELSE 0 END AS s FROM v)"""


def bent(spark, sf_dir) -> FitResult:
    y = "100 + p_size * 3.0D + CASE WHEN p_brand < 'Brand#3' THEN 0.2D * (p_size - 25) * (p_size - 25) ELSE 0D END + (p_partkey * 7919 % 23 - 11) * 0.5D"
    return fit(table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.expr(y).alias("y"), F.col("p_size").cast("double").alias("x1")))


@query(VERDICT + f" SELECT g AS \"group\", CASE WHEN curved THEN 'x1' END AS curved_term, CASE WHEN curved THEN {O.rounded('best', 4)} ELSE 0.0 END AS curved_t, CASE WHEN curved THEN pow ELSE 0 END AS curved_pow, {O.rounded('f', 4, 'fitted_t')}, {O.rounded('s', 4, 'spread_t')} FROM w")
def diag_verdict(spark, sf_dir):
    v = D.verdicts(bent(spark, sf_dir))
    return v.select("group", "curved_term", rnd(F.col("curved_t"), 4).alias("curved_t"), "curved_pow", rnd(F.col("fitted_t"), 4).alias("fitted_t"), rnd(F.col("spread_t"), 4).alias("spread_t"))


@query(VERDICT + f" SELECT arg_max(CASE WHEN curved THEN g END, CASE WHEN curved THEN abs(best) END) AS worst_group, max(CASE WHEN curved THEN 'x1' END) AS curved_term, coalesce({O.rounded('arg_max(best, CASE WHEN curved THEN abs(best) END)', 4)}, 0.0) AS curved_t, coalesce(arg_max(pow, CASE WHEN curved THEN abs(best) END), 0) AS curved_pow, {O.rounded('arg_max(f, abs(f))', 4, 'fitted_t')}, {O.rounded('max(s)', 4, 'spread_t')} FROM w")
def diag_summary(spark, sf_dir):
    s = D.summary(bent(spark, sf_dir))
    return s.select("worst_group", "curved_term", rnd(F.col("curved_t"), 4).alias("curved_t"), "curved_pow", rnd(F.col("fitted_t"), 4).alias("fitted_t"), rnd(F.col("spread_t"), 4).alias("spread_t"))


MODEL = [("A", 100.25, [16.125, -640.5]), ("N", -3.5, [0.0000015, 1.0]), ("R", 12.0, [2.5, 1.0 / 3.0])]
MODEL_SQL = "(VALUES ('A', 100.25::DOUBLE, 16.125::DOUBLE, -640.5::DOUBLE), ('N', -3.5::DOUBLE, 0.0000015::DOUBLE, 1.0::DOUBLE), ('R', 12.0::DOUBLE, 2.5::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE)) AS m(\"group\", b0, b1, b2)"
TRIMS = [("N", 5.0), ("A", 1.05), ("Q", 3.0), ("N", 0.25)]
TRIM_SQL = "CASE \"group\" WHEN 'A' THEN 1.05::DOUBLE WHEN 'N' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END"
CASE_SQL = "SELECT l_orderkey AS id, l_linenumber AS nr, CASE WHEN l_orderkey % 7 = 0 THEN 'Z' || (l_orderkey % 3) ELSE l_returnflag END AS \"group\", l_quantity AS x1, l_discount AS x2 FROM lineitem"


def model(spark) -> DataFrame:
    return spark.createDataFrame(MODEL, "group string, intercept double, coef array<double>")


def trims(spark) -> DataFrame:
    """The trim table, read from its text."""
    text = ["group,trim_addition", "# a note", *[f"{g} , {t!r}" for g, t in TRIMS], ""]
    return trims_from(spark.createDataFrame(list(enumerate(text)), "row_id long, value string"))


def cases(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    group = F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("Z"), (F.col("l_orderkey") % 3).cast("string"))).otherwise(F.col("l_returnflag"))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nr"), group.alias("group"), F.array("l_quantity", "l_discount").alias("x"))


def scored_sql(scale: int) -> str:
    return f"s AS (SELECT id, nr, c.\"group\", round((b0 + b1 * x1 + b2 * x2) * 1e{scale}) / 1e{scale} AS prediction FROM ({CASE_SQL}) c JOIN {MODEL_SQL} ON c.\"group\" = m.\"group\")"


@query(f"WITH {scored_sql(4)} SELECT * FROM s")
def score_case_rows(spark, sf_dir):
    return score_rows(cases(spark, sf_dir), model(spark)).select("id", "nr", "group", "prediction")


@query(f"WITH {scored_sql(2)} SELECT * FROM s")
def score_scale(spark, sf_dir):
    return score_rows(cases(spark, sf_dir), model(spark), scale=2).select("id", "nr", "group", "prediction")


@query(f"WITH {scored_sql(4)} SELECT *, round((prediction + {TRIM_SQL}) * 1e1) / 1e1 AS \"trim\" FROM s")
def score_trim(spark, sf_dir):
    return score_rows(cases(spark, sf_dir), model(spark), trims(spark)).select("id", "nr", "group", "prediction", "trim")


@query(f"WITH {scored_sql(4)} SELECT id, nr, \"group\" || ' prediction=' || printf('%.4f', prediction) || ' trim=' || printf('%.1f', round((prediction + {TRIM_SQL}) * 1e1) / 1e1) AS line FROM s")
def score_lines(spark, sf_dir):
    return score_text(score_rows(cases(spark, sf_dir), model(spark), trims(spark))).select("id", "nr", "line")


@query(f"SELECT \"group\", count(*) AS n FROM ({CASE_SQL}) WHERE \"group\" NOT IN ('A', 'N', 'R') GROUP BY 1")
def score_rejects(spark, sf_dir):
    return unknown_groups(cases(spark, sf_dir), model(spark)).groupBy("group").agg(F.count("*").alias("n"))


def assignments() -> Column:
    quantity = F.concat(F.lit("QTY="), F.col("l_quantity").cast("int").cast("string"))
    return F.when(F.col("l_linenumber") == 1, F.array(quantity)).when(F.col("l_linenumber") == 2, F.array(F.lit("disc=3"), quantity, F.lit("Disc=4.5"))).when(F.col("l_linenumber") == 3, F.array(F.lit("colour=1"))).when(F.col("l_linenumber") == 4, F.array(F.lit("disc"))).when(F.col("l_linenumber") == 5, F.array(F.lit("disc=0x10"))).otherwise(F.array().cast("array<string>"))


@query(f"SELECT l_orderkey AS id, l_linenumber AS nr, l_returnflag AS \"group\", round((b0 + b1 * CASE WHEN l_linenumber <= 2 THEN l_quantity ELSE 0 END + b2 * CASE WHEN l_linenumber = 2 THEN 4.5::DOUBLE ELSE 0 END) * 1e4) / 1e4 AS prediction FROM lineitem JOIN {MODEL_SQL} ON l_returnflag = m.\"group\" WHERE l_linenumber NOT IN (3, 4, 5)")
def score_named_cases(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nr"), F.col("l_returnflag").alias("group"), assignments().alias("assignments"))
    return score_named(rows, model(spark), ["qty", "disc"]).select("id", "nr", "group", "prediction")


@query("SELECT CASE l_linenumber WHEN 3 THEN 'UNKNOWN_TERM' WHEN 4 THEN 'NOT_ASSIGNMENT' WHEN 5 THEN 'BAD_VALUE' END AS refusal, count(*) AS n FROM lineitem GROUP BY 1")
def score_named_refusals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(named_case(assignments(), ["qty", "disc"])[1].alias("refusal")).groupBy("refusal").agg(F.count("*").alias("n"))


NUMBERS = [("1", 1.0), ("-2.5", -2.5), ("+.5", 0.5), ("7.", 7.0), ("1e3", 1000.0), ("1E-3", 0.001), ("1e-320", 1e-320), ("  4", 4.0), ("4  ", 4.0), ("\t4", 4.0), ("0.1", 0.1), ("123456789012345678", 123456789012345678.0), *[(t, None) for t in ("", " ", "4\t", "nan", "inf", "-Infinity", "1e400", "0x10", "0X1p4", "-0x10", "1d", "1f", "1,5", "1e", ".", "e5", "1_000", "--1", "4 4", "NA")]]


def sql_text(v: str) -> str:
    return " || ".join("chr(9)" if c == "\t" else f"'{c}'" for c in v) if "\t" in v else f"'{v}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({sql_text(t)}, {'NULL' if v is None else repr(v)}::DOUBLE)" for t, v in NUMBERS) + ") AS v(txt, num)")
def parse_numbers(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in NUMBERS], "txt string").select("txt", parse_number(F.col("txt")).alias("num"))


ROUNDS = [2.5, -2.5, 1.005, 0.49999999999999994, -0.5, 2.675, 1e300, 123456.78905, -1.00005]


@query("SELECT v, round(v) + 0.0 AS r0, round(v * 1e2) / 1e2 + 0.0 AS r2, CASE WHEN abs(v) > 1.7976931348623157e308 / 1e9 THEN v ELSE round(v * 1e9) / 1e9 END + 0.0 AS r9 FROM (VALUES " + ", ".join(f"({v!r}::DOUBLE)" for v in ROUNDS) + ") AS t(v)")
def rounding(spark, sf_dir):
    v = F.col("v")
    return spark.createDataFrame([(x,) for x in ROUNDS], "v double").select("v", *[(round_half_away(v, k) + F.lit(0.0)).alias(f"r{k}") for k in (0, 2, 9)])


#: Thirteen digits that end in 5: to twelve of them it is the binary value that decides.
TIE = "(1000000000000 + l_orderkey * 10 + 5) / 1e13"


@query(f"SELECT l_orderkey AS id, l_linenumber AS nr, printf('%.12g', l_extendedprice * (1 - l_discount) / 7) AS text, printf('%.12g', {TIE}) AS tie, printf('%.6f', l_quantity / 64) AS six FROM lineitem")
def significant_digits(spark, sf_dir):
    v = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7
    tie = F.expr(TIE.replace("1e13", "1e13D"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nr"), significant(v).alias("text"), significant(tie).alias("tie"), printed(F.col("l_quantity") / 64, "%.6f").alias("six"))


def steady(result: FitResult) -> FitResult:
    """A fit without its last digits, which go by the order of additions."""
    own = {"intercept": rnd(F.col("intercept")), "coef": F.transform("coef", lambda b: rnd(b)), "r2": rnd(F.col("r2"), 9), "resid_sd": rnd(F.col("resid_sd"), 5), "cond": rnd(F.col("cond"), 9)}
    return FitResult(result.schema, result.solver, result.selection, result.train, result.fits.withColumns(own))


def named(spark, sf_dir) -> DataFrame:
    return priced(spark, sf_dir, 2).select("g", F.col("y").alias("price"), F.col("x1").alias("x"), F.col("x2").alias("z"))


@query(f"WITH {O.solved(priced_sql(2), 2)} SELECT g AS \"group\", {O.rounded('b0', 6, 'intercept')}, {O.rounded('b1', 6, 'x')}, {O.rounded('b2', 6, 'z')}, 'price' AS response, 2 AS n_terms FROM b")
def model_roundtrip(spark, sf_dir):
    """A fitted model, written as a text file and read back."""
    path = scratch(spark, "model")
    write_text(model_lines(steady(fit(named(spark, sf_dir)))), path)
    read = read_model(spark, path)
    return read.rows.select("group", "intercept", F.col("coef")[0].alias("x"), F.col("coef")[1].alias("z"), F.lit(read.response).alias("response"), F.lit(len(read.terms)).alias("n_terms"))


DIGITS = lambda expr, digits: f"printf('%.12g', {O.rounded(expr, digits)})"


@query(f"WITH {O.solved(priced_sql(2), 2)} SELECT 0 AS part, concat_ws(',', g, {DIGITS('b0', 6)}, {DIGITS('b1', 6)}, {DIGITS('b2', 6)}) AS line FROM b UNION ALL SELECT 1, 'group,intercept,x,z' UNION ALL SELECT 0, '# response: price'")
def model_text(spark, sf_dir):
    return model_lines(steady(fit(named(spark, sf_dir)))).select("part", "line")


@query(f"WITH {O.with_stats(priced_sql(2), 2)} SELECT concat_ws(',', g, n, df, printf('%.6f', {O.rounded('r2', 9)}), {DIGITS('sd', 5)}, printf('%.6g', {O.rounded('1 / (1 - s12 * s12 / (s11 * s22))', 9)}), 0) AS line FROM st UNION ALL SELECT 'group,rows,df,r2,resid_sd,cond,pinned'")
def stats_text(spark, sf_dir):
    return stats_lines(steady(fit(priced(spark, sf_dir, 2)))).select("line")


@query("SELECT concat_ws(',', l_returnflag, count(*), count(*) - 2, '', '', printf('%.6g', 1::DOUBLE), 0) AS line FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'group,rows,df,r2,resid_sd,cond,pinned'")
def stats_text_flat(spark, sf_dir):
    """Blanks for what is undefined."""
    train = priced(spark, sf_dir, 1).select("g", F.lit(5.0).alias("five"), "x1")
    return stats_lines(fit(train)).select("line")


@query(f"WITH {O.solved(priced_sql(2), 2)} SELECT concat_ws(',', src.g, printf('%.12g', y), {DIGITS('b0 + b1 * x1 + b2 * x2', 4)}, {DIGITS('y - (b0 + b1 * x1 + b2 * x2)', 4)}) AS line FROM src JOIN b ON src.g = b.g")
def residual_text(spark, sf_dir):
    r = residuals(fit(priced(spark, sf_dir, 2)))
    return residual_lines(r.withColumns({k: rnd(F.col(k), 4) for k in ("predicted", "residual")}))


@query(f"""WITH {O.solved(priced_sql(2), 2)}, seen AS (SELECT l_returnflag AS g, row_number() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber)) AS place FROM lineitem GROUP BY 1)
SELECT b.g AS "group", n AS rows, {O.rounded('b0', 6, 'b0')}, {O.rounded('b1', 6, 'b1')}, {O.rounded('b2', 6, 'b2')}, place FROM b JOIN seen ON b.g = seen.g""")
def fit_files(spark, sf_dir):
    """A training table in several text files, with comments: fitted as read, groups placed as they are first seen over all files."""
    path, rows = scratch(spark, "training"), table(spark, sf_dir, "lineitem")
    # every file of a folder is a part of one table; the header stands in the first alone
    ordered = rows.repartitionByRange(3, "l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber")
    line = F.concat_ws(",", "l_returnflag", *[F.col(v).cast("string") for v in list(LINES.values())[:3]])
    note = F.when(F.col("l_orderkey") % 97 == 0, F.concat(F.lit("# order "), F.col("l_orderkey").cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    lines = ordered.select(F.concat(note, line).alias("value"))
    lines.write.text(path)
    spark.createDataFrame([("# prices\n\nflag,price,quantity,discount",)], "value string").coalesce(1).write.text(f"{path}-head")
    read = read_training(spark, [f"{path}-head", path])
    fits = fit(read).kept
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")).cast("long")
    return coefs(fit(read)).join(fits.select("group", place.alias("place")), "group")


@query(f"""WITH {O.with_stats(priced_sql(2), 2)}
SELECT 1 AS nr, 'reading: column 1 is the group, ''y'' is the value being predicted, and the other 2 columns are terms' AS line
UNION ALL SELECT 2, 'fit: ' || count(*) || ' groups, ' || sum(n)::BIGINT || ' rows, worst R2=' || printf('%.4f', min(r2)) || ', worst resid SD=' || printf('%.4g', max(sd)) || ', least df=' || min(df) || ', worst cond=' || printf('%.3g', max(1 / (1 - s12 * s12 / (s11 * s22)))) || ' (normal equations)' FROM st""")
def commentary(spark, sf_dir):
    lines = report(fit(priced(spark, sf_dir, 2)))
    return spark.createDataFrame(list(enumerate(lines, 1)), "nr int, line string")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'flat' AS about, count(*) || ' groups without R2, because the response does not vary there: it is undefined, not zero.' AS line FROM g
UNION ALL SELECT 'df', 'some group has no residual degrees of freedom: its line goes through every row by construction. Fit it on more rows.' FROM g HAVING min(n) <= 2""")
def commentary_warnings(spark, sf_dir):
    """The warnings on a fit of one group an order, whose response never varies."""
    train = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("g"), F.lit(5.0).alias("y"), F.col("l_linenumber").cast("double").alias("x1"))
    found = [x.removeprefix("warning: ") for x in report(fit(train)) if x.startswith("warning: ")]
    return spark.createDataFrame([("flat" if "vary" in x else "df", x) for x in found], "about string, line string")


RAW = ["group,y,x", "﻿A, 1 ,2\r", "", "   ", "# note", "A\rB,1,2", " #x,1,2", "B,1,,3", "a" * 18000]
LINE_ROWS = [(0, "data", None, 3), (1, "data", None, 3), (2, "blank", None, 1), (3, "blank", None, 1), (4, "comment", None, 1), (5, "data", "LINE_CR", 3), (6, "comment", None, 3), (7, "data", None, 4), (8, "data", "LINE_TOO_LONG", 1)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{k}', {'NULL' if e is None else repr(e)}, {n})" for i, k, e, n in LINE_ROWS) + ") AS v(row_id, kind, line_error, n_fields)")
def src_lines(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(RAW)), "row_id long, value string")
    return logical_lines(lines).select("row_id", "kind", "line_error", F.size(fields(F.col("line"))).alias("n_fields"))


@query("SELECT l_orderkey AS id, l_linenumber AS nr, list_transform(string_split(l_returnflag || ' ,  ' || l_linenumber || ',' || chr(9) || 'x ,', ','), lambda f: trim(f, ' ')) AS f FROM lineitem")
def src_fields(spark, sf_dir):
    line = F.concat(F.col("l_returnflag"), F.lit(" ,  "), F.col("l_linenumber").cast("string"), F.lit(",\tx ,"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nr"), fields(line).alias("f"))


FAULTS = [(2, "COMMENT_DATA_SHAPED", "'#' || l_returnflag || ',1,2'"), (3, "FIELD_COUNT", "l_returnflag || ',1'"), (5, "FIELD_QUOTED", "l_returnflag || ',\"1\",2'"), (7, "BAD_GROUP", "',1,2'"), (11, "BAD_RESPONSE", "l_returnflag || ',high,2'"), (13, "BAD_TERM", "l_returnflag || ',1,NA'"), (17, "BAD_TERM", "l_returnflag || ',1,'"), (19, "FIELD_COUNT", "l_returnflag || ';1;2'")]
FAULT_CASE = "CASE " + " ".join(f"WHEN l_orderkey % 23 = {k} THEN {line}" for k, _, line in FAULTS) + " ELSE l_returnflag || ', ' || l_orderkey || ' ,' || l_linenumber END"


@query("SELECT CASE " + " ".join(f"WHEN l_orderkey % 23 = {k} THEN '{code}'" for k, code, _ in FAULTS) + " END AS code, count(*) AS n FROM lineitem GROUP BY 1")
def src_reject(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.expr(FAULT_CASE).alias("value"))
    parsed = parse_rows(logical_lines(lines), ["group", "y", "x"], 1)
    return parsed.groupBy(F.col("refusal.code").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_linenumber = 3 THEN 'FIELD_COUNT' WHEN l_linenumber = 4 THEN 'BAD_TERM' END AS code, count(*) AS n FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1")
def src_cases(spark, sf_dir):
    line = F.expr("CASE l_linenumber WHEN 3 THEN '  ' WHEN 4 THEN 'A,1,x' WHEN 5 THEN '#A,1,2' ELSE 'A,1,2' END")
    good, bad = cases_from(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), line.alias("value")), ["x", "z"])
    return good.select(F.lit(None).cast("string").alias("code")).unionByName(bad.select("refusal.code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1, 'stops'), (2, 'Lights')) AS v(nr, term)")
def schema_terms(spark, sf_dir):
    s = FitSchema.of(["route", "stops", "minutes", "Lights"], "MINUTES")
    return spark.createDataFrame([(list(s.terms),)], "t array<string>").select(F.posexplode("t").alias("nr", "term")).withColumn("nr", F.col("nr") + 1)


@query("SELECT p::INTEGER AS p, (8 * (p * p + 19 * p + 29) + 216)::BIGINT AS fit_bytes, 2064::BIGINT AS model_bytes, (8 * (p * p + 19 * p + 29) + 216) * 580::BIGINT AS fit_580 FROM range(1, 257) AS t(p)")
def footprints(spark, sf_dir):
    rows = [(p, fit_bytes(p), model_bytes(), footprint(p, 580)["fit_bytes"]) for p in range(1, 257)]
    return spark.createDataFrame(rows, "p int, fit_bytes long, model_bytes long, fit_580 long")


@query(O.fitted(priced_sql(2), 2))
def fit_streaming(spark, sf_dir):
    """The fit over a stream of the lineitem files: the last batch's result."""
    return streamed(spark, sf_dir, "normal")


def streamed(spark, sf_dir, solver: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "lineitem*.parquet").option("maxFilesPerTrigger", 4).parquet(sf_dir)
    train = stream.select(F.col("l_returnflag").alias("g"), *[F.col(v).alias(k) for k, v in list(LINES.items())[:3]])
    out, schema = scratch(spark, "fits"), FitSchema("g", "y", ("x1", "x2"))

    def sink(fits: DataFrame, batch: int) -> None:
        fits.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    start_fit(train, schema, sink, scratch(spark, "state"), solver=solver).awaitTermination()
    all_ = spark.read.parquet(out)
    last = all_.agg(F.max("batch")).first()[0]
    return coefs(FitResult(schema, solver, None, train, all_.where(F.col("batch") == last)))


@query(O.fitted(priced_sql(2), 2))
def fit_streaming_qr(spark, sf_dir):
    """The same stream by triangular factors, whose states are kept as tables."""
    return streamed(spark, sf_dir, "qr")


@query(f"WITH {scored_sql(4)} SELECT \"group\", count(*) AS n, min(prediction) AS lo, max(prediction) AS hi FROM s GROUP BY 1")
def score_streaming(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    group = F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("Z"), (F.col("l_orderkey") % 3).cast("string"))).otherwise(F.col("l_returnflag"))
    out = scratch(spark, "scores")
    scored = score_stream(stream.select(group.alias("group"), F.array("l_quantity", "l_discount").alias("x")), model(spark)).select("group", "prediction")
    scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("group string, prediction double").parquet(out).groupBy("group").agg(F.count("*").alias("n"), F.min("prediction").alias("lo"), F.max("prediction").alias("hi"))


@query("SELECT l_returnflag AS \"group\", count(*) AS rows, 0 AS pinned, 1.0::DOUBLE AS r2, " + ", ".join(f"{0.25 * (k + 1)}::DOUBLE AS b{k + 1}" for k in range(24)) + " FROM lineitem GROUP BY 1")
def fit_wide_24(spark, sf_dir):
    """24 terms, whose response is an exact line of them."""
    rows = table(spark, sf_dir, "lineitem")
    term = lambda k: F.pmod(F.xxhash64(F.lit(k), "l_orderkey", "l_linenumber"), F.lit(1000)).cast("double") / 100
    x = rows.select("l_returnflag", *[term(k).alias(f"x{k + 1}") for k in range(24)])
    y = sum((0.25 * (k + 1) * F.col(f"x{k + 1}") for k in range(24)), F.lit(3.0))
    f = fit(x.select("l_returnflag", y.alias("y"), *[f"x{k + 1}" for k in range(24)])).fits
    return f.select("group", "rows", "pinned", rnd(F.col("r2"), 9).alias("r2"), *[rnd(F.col("coef")[k], 5).alias(f"b{k + 1}") for k in range(24)])


def refused(f: Callable[[], object]) -> str:
    try:
        f()
    except FitError as e:
        return e.code
    return "OK"


def error_cases(spark) -> dict[str, Callable[[], object]]:
    frame = lambda rows, p=1: spark.createDataFrame(rows, "g string, y double, " + ", ".join(f"x{k + 1} double" for k in range(p)))
    lines = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "row_id long, value string")
    big = [("A", (-1.0) ** k * 1e160, float(k)) for k in range(8)]
    wide = [("A", 1.0 + k, 1e160 * (1 + 0.1 * k)) for k in range(8)]
    few = [("A", 1.0, 1.0), ("A", 2.0, 2.0), ("A", 4.0, 3.0)]
    return {
        "fine": lambda: fit(frame(few)).check(),
        "no_rows": lambda: fit(frame([])).check(),
        "no_such_group": lambda: fit(frame(few), group="B").check(),
        "all_singleton": lambda: fit(frame([("A", 1.0, 1.0), ("B", 1.0, 1.0), ("C", 1.0, 1.0)])).check(),
        "null_value": lambda: fit(frame([*few, ("A", None, 1.0)])).check(),
        "nan_in_another_group": lambda: fit(frame([*few, ("B", 1.0, float("nan"))]), group="A").check(),
        "response_overflow": lambda: fit(frame(big)).check(),
        "response_overflow_qr": lambda: fit(frame(big), solver="qr").check(),
        "column_overflow": lambda: fit(frame(wide)).check(),
        "column_overflow_tasks": lambda: fit(frame(wide), sql_terms=0).check(),
        "column_overflow_qr": lambda: fit(frame(wide), solver="qr").check(),
        "long_group": lambda: fit(frame([("g" * 32, y, x) for _, y, x in few])).check(),
        "unknown_response": lambda: FitSchema.of(["g", "y", "x"], "z"),
        "response_is_group": lambda: FitSchema.of(["g", "y", "x"], "G"),
        "narrow": lambda: FitSchema.of(["g", "y"]),
        "same_terms": lambda: FitSchema.of(["g", "y", "x", "X"]),
        "scale": lambda: score_rows(frame(few), frame(few), scale="3.9"),
        "semicolons": lambda: training_from(lines("g;y;x", "A;1;2")),
        "tabs": lambda: training_from(lines("g\ty\tx")),
        "no_header": lambda: training_from(lines("# only", "")),
        "bad_row": lambda: training_from(lines("g,y,x", "A,1,2", "A,1,NA")).check(),
        "comment_row": lambda: training_from(lines("g,y,x", "A,1,2", "#B,9,9")).check(),
        "headerless_model": lambda: model_from(lines("X,10,1", "Y,20,1")),
        "group_twice": lambda: model_from(lines("group,intercept,a", "X,10,1", "X,999,1")),
        "stream_residuals": lambda: residuals(FitResult(FitSchema("g", "y", ("x",)), "normal", None, spark.readStream.format("rate").load(), frame(few))),
        "trim_fields": lambda: trims_from(lines("group,trim_addition", "X,1,2")),
        "bad_trim": lambda: trims_from(lines("group,trim_addition", "X,1", "X,one")),
        "empty_trims": lambda: trims_from(lines("# nothing")),
        "missing_file": lambda: read_training(spark, "/nonexistent/training.csv"),
        "bad_coef": lambda: model_from(lines("group,intercept,a", "X,10,nan")),
    }


OUTCOMES = {
    "fine": "OK", "no_rows": "NO_ROWS", "no_such_group": "GROUP_NOT_FOUND", "all_singleton": "ALL_SINGLETON", "null_value": "NOT_FINITE", "nan_in_another_group": "NOT_FINITE",
    "response_overflow": "RESPONSE_OVERFLOW", "response_overflow_qr": "RESPONSE_OVERFLOW", "column_overflow": "COLUMN_OVERFLOW", "column_overflow_tasks": "COLUMN_OVERFLOW", "column_overflow_qr": "OK",
    "long_group": "BAD_GROUP", "unknown_response": "RESPONSE_UNKNOWN", "response_is_group": "RESPONSE_IS_GROUP", "narrow": "HEADER_TOO_NARROW", "same_terms": "BAD_TERMS", "scale": "BAD_SCALE",
    "semicolons": "HEADER_SEMICOLON", "tabs": "HEADER_TAB", "no_header": "NO_HEADER", "bad_row": "BAD_TERM", "comment_row": "COMMENT_DATA_SHAPED", "headerless_model": "HEADER_NUMERIC", "group_twice": "GROUP_DUPLICATE", "stream_residuals": "RESIDUALS_NEED_FILE", "trim_fields": "TRIM_FIELDS", "bad_trim": "BAD_TRIM", "empty_trims": "TRIM_EMPTY", "missing_file": "NOT_FOUND", "bad_coef": "BAD_COEF",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in OUTCOMES.items()) + ") AS v(attempt, outcome)")
def errors(spark, sf_dir):
    return spark.createDataFrame([(k, refused(f)) for k, f in error_cases(spark).items()], "attempt string, outcome string")
