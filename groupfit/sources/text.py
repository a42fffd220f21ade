"""Reading comma-separated text: lines, fields, training rows, coefficient and trim tables, cases.

Fields are split on commas and trimmed of spaces; there is no quoting. Whatever
could be read in two ways is refused, with a code and the place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FitError
from ..functions.numbers import parse_number
from ..schema import MAX_FIELDS, MAX_GROUP_BYTES, MAX_LINE_BYTES, FitSchema, check_terms

BOM = "﻿"


#: Bits of a place in several files that count the lines of one.
FILE_BITS = 40


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row_id, value): physical lines in order. Only a line feed ends a line, so a bare carriage return stays visible.

    The order is that of the files' names, however the scan packs them: parts of a file are numbered in the order of their blocks, and the
    number of the file among all, which the driver lists, comes first.
    """
    try:
        lines = spark.read.text(path, lineSep="\n")
        files = sorted(lines.inputFiles())
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FitError("NOT_FOUND", f"cannot open {path}") from None
        raise
    if len(files) < 2:
        return lines.select(F.monotonically_increasing_id().alias("row_id"), "value")
    # blocks are read whole, so the place of a block and the number of the line in its task order the lines of a file
    nth = spark.createDataFrame(list(enumerate(files)), "nth long, file string")
    rows = lines.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    starts = rows.groupBy("file", "block").agg(F.min("n").alias("low"), (F.max("n") - F.min("n") + 1).alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = starts.select("file", "block", "low", before.alias("before")).join(F.broadcast(nth), "file")
    place = F.shiftleft("nth", FILE_BITS) + F.col("before") + F.col("n") - F.col("low")
    return rows.join(F.broadcast(known) if len(files) <= 10_000 else known, ["file", "block"]).select(place.alias("row_id"), "value")


def logical_lines(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """lines (row_id, value) as (row_id, line, kind, line_error): kind is data, comment or blank; the error is LINE_NUL, LINE_CR or LINE_TOO_LONG."""
    raw = F.regexp_replace("value", r"\r\z", "")
    error = F.when(F.octet_length(raw) > max_line_bytes, "LINE_TOO_LONG").when(F.instr(raw, "\0") > 0, "LINE_NUL").when(F.instr(raw, "\r") > 0, "LINE_CR")
    line = F.trim(F.when(F.startswith(raw, F.lit(BOM)), F.substr(raw, F.lit(2))).otherwise(raw))
    kind = F.when(F.col("line") == "", "blank").when(F.startswith("line", F.lit("#")), "comment").otherwise("data")
    return lines.select("row_id", line.alias("line"), error.alias("line_error")).withColumn("kind", kind)


def fields(line: Column) -> Column:
    return F.transform(F.split(line, ",", -1), lambda f: F.trim(f))


def separator(line: Column) -> Column:
    """semicolons or tabs, where a line has those and no commas."""
    return F.when(F.instr(line, ",") > 0, None).when(F.instr(line, ";") > 0, "semicolons").when(F.instr(line, "\t") > 0, "tabs")


def shown(value: Column) -> Column:
    """Enough of a field to know it by."""
    return F.when(value == "", "empty").when(F.octet_length(value) <= 24, F.concat(F.lit("'"), value, F.lit("'"))).otherwise(F.concat(F.lit("'"), F.substring(value, 1, 24), F.lit("...'")))


def quoted(value: Column) -> Column:
    return value.rlike("""^["']|["']\\z""")


def parse_rows(lines: DataFrame, names: list[str], response: int | None) -> DataFrame:
    """Adds group, y, x and refusal (code, field, value, reason; null where the row is fine) to lines (line, kind, line_error).

    names: of all columns; response: its place, or None for cases, where all columns after the group are terms. The first thing wrong with a row is what is told.
    """
    n = len(names)
    f, line = F.col("fields"), F.col("line")
    at = [k for k in range(1, n) if k != response]
    labels = F.array(*[F.lit(x) for x in ["the group column", *names[1:]]])
    value = lambda k: F.try_element_at(f, F.lit(k + 1))

    def refusal(code: str, field: Column | None = None, found: Column | None = None, reason: Column | str = "") -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(code).alias("code"), (none if field is None else field).alias("field"), (none if found is None else shown(found)).alias("value"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    size = F.size(f)
    count = F.concat(F.lit("it has "), size.cast("string"), F.when(size == 1, " field").otherwise(" fields"), F.lit(f" and the header names {n}"))
    apart = F.concat(F.lit("it has no commas, but does have "), separator(line))
    marks = line.rlike("[\"']")
    why = F.when((size == 1) & separator(line).isNotNull(), apart).when(size > MAX_FIELDS, f"it has more than {MAX_FIELDS} fields").when(marks, F.concat(count, F.lit(", and the row contains a quote"))).otherwise(count)
    first_quoted = F.try_element_at(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda k: quoted(F.try_element_at(f, k))), F.lit(1))
    group = value(0)
    numbers = F.transform(F.array(*[value(k) for k in at]), lambda v: parse_number(v))
    first_bad = F.array_position(F.transform(numbers, lambda v: v.isNull()), True).cast("int")
    places = F.array(*[F.lit(k + 1) for k in at])
    term_at = F.element_at(places, first_bad)
    not_number = "which is not a number: there is no imputation for an empty field and no encoding for a category name"

    chain = F.when(F.col("line_error").isNotNull(), F.struct(F.col("line_error").alias("code"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit("the line can't be read").alias("reason")))
    chain = chain.when(F.col("kind") == "comment", refusal("COMMENT_DATA_SHAPED", reason="a line beginning with '#' has the shape of a data row"))
    chain = chain.when(size != n, refusal("FIELD_COUNT", reason=why))
    chain = chain.when(first_quoted.isNotNull(), refusal("FIELD_QUOTED", F.element_at(labels, first_quoted), F.try_element_at(f, first_quoted), "it is quoted, and quotes are not stripped"))
    chain = chain.when((group == "") | (F.octet_length(group) > MAX_GROUP_BYTES), refusal("BAD_GROUP", F.lit("the group column"), group, f"it is empty or longer than {MAX_GROUP_BYTES} bytes"))
    if response is not None:
        chain = chain.when(parse_number(value(response)).isNull(), refusal("BAD_RESPONSE", F.lit(names[response]), value(response), not_number))
    chain = chain.when(first_bad > 0, refusal("BAD_TERM", F.element_at(labels, term_at), F.try_element_at(f, term_at), not_number))
    # a comment is a row only where it could be one
    rows = lines.withColumn("fields", fields(line)).where((F.col("kind") == "data") | F.col("line_error").isNotNull() | ((F.col("kind") == "comment") & (F.size("fields") == n)))
    y = parse_number(value(response)) if response is not None else F.lit(None).cast("double")
    return rows.withColumn("refusal", chain).withColumns({"group": group, "y": y, "x": numbers}).drop("fields")


@dataclass(frozen=True)
class TextTable:
    """Rows of a training file: (row_id, group, y, x) and what was refused."""

    schema: FitSchema
    rows: DataFrame
    refused: DataFrame

    def check(self) -> TextTable:
        """A fit takes all rows of a file or none: raises for the first refused one."""
        bad = self.refused.orderBy("row_id").limit(1).collect()
        if bad:
            r = bad[0]["refusal"]
            raise FitError(r["code"], " ".join(str(x) for x in ("row", bad[0]["line"][:60], r["field"] or "", r["value"] or "", r["reason"]) if x))
        return self

    def table(self) -> DataFrame:
        """The rows under the file's own column names, for `fit`."""
        s = self.schema
        return self.rows.select(F.col("group").alias(s.group), F.col("y").alias(s.response), *[F.col("x")[k].alias(t) for k, t in enumerate(s.terms)])


def header_of(lines: DataFrame, what: str, least: int = 3) -> tuple[int, list[str], str | None]:
    """(row_id, names, response named in the comments before it) of the header, the first line that is neither blank nor a comment."""
    got = lines.where((F.col("kind") == "data") | F.col("line_error").isNotNull()).agg(F.min_by(F.struct("row_id", "line", "line_error"), "row_id")).first()[0]
    if got is None:
        raise FitError("NO_HEADER", f"{what} has no header line")
    if got["line_error"]:
        raise FitError(got["line_error"], f"{what} has a line that can't be read")
    names = [f.strip(" ") for f in got["line"].split(",")]
    if len(names) < least:
        if len(names) == 1 and (";" in names[0] or "\t" in names[0]):
            raise FitError("HEADER_SEMICOLON" if ";" in names[0] else "HEADER_TAB", f"{what} has no commas in its header, but does have {'semicolons' if ';' in names[0] else 'tabs'}")
        raise FitError("HEADER_TOO_NARROW", f"{what} has {len(names)} columns in its header; {least} are needed")
    name = F.regexp_extract("line", r"^[# \t]*response:[ \t]*(.*)$", 1)
    said = lines.where((F.col("kind") == "comment") & (F.col("row_id") < got["row_id"])).agg(F.max_by(F.when(name != "", name), F.when(name != "", F.col("row_id")))).first()[0]
    return got["row_id"], names, said


def read_training(spark: SparkSession, path: str | list[str], response: str | None = None, max_line_bytes: int = MAX_LINE_BYTES) -> TextTable:
    return training_from(read_lines(spark, path), str(path), response, max_line_bytes)


def training_from(lines: DataFrame, what: str = "the table", response: str | None = None, max_line_bytes: int = MAX_LINE_BYTES) -> TextTable:
    lines = logical_lines(lines, max_line_bytes)
    at, names, _ = header_of(lines, what)
    schema = FitSchema.of(names, response)
    place = names.index(schema.response, 1)
    parsed = parse_rows(lines.where(F.col("row_id") > at), names, place)
    return TextTable(schema, parsed.where("refusal is null").select("row_id", "group", "y", "x"), parsed.where("refusal is not null").select("row_id", "line", "refusal"))


@dataclass(frozen=True)
class Model:
    """A coefficient table as it was read: its terms, the response it names and a row for each group."""

    terms: tuple[str, ...]
    response: str | None
    rows: DataFrame

    def listing(self) -> list[str]:
        """What the model needs of a case."""
        out = [f"{len(self.terms)} term{'s' * (len(self.terms) != 1)}, {self.rows.count()} groups"]
        if self.response:
            out.append(f"it predicts: {self.response}")
        return out + [f"{k}. {t}" for k, t in enumerate(self.terms, 1)]


def read_model(spark: SparkSession, path: str, max_line_bytes: int = MAX_LINE_BYTES) -> Model:
    return model_from(read_lines(spark, path), path, max_line_bytes)


def model_from(lines: DataFrame, what: str = "the model", max_line_bytes: int = MAX_LINE_BYTES) -> Model:
    """A coefficient table (group, intercept, terms) from lines (row_id, value). Any row that can't be read refuses the table."""
    lines = logical_lines(lines, max_line_bytes)
    at, names, said = header_of(lines, what)
    heads = lines.sparkSession.createDataFrame([(x,) for x in names[1:]], "v string").where(parse_number(F.col("v")).isNull())
    if heads.isEmpty():
        raise FitError("HEADER_NUMERIC", f"{what} starts with a row of numbers where its header should be")
    terms = check_terms(names[2:])
    n = len(names)
    rows = lines.where(F.col("row_id") > at).withColumn("fields", fields(F.col("line")))
    rows = rows.where((F.col("kind") == "data") | F.col("line_error").isNotNull() | ((F.col("kind") == "comment") & (F.size("fields") == n)))
    value = lambda k: F.try_element_at("fields", F.lit(k + 1))
    coef = F.array(*[parse_number(value(k)) for k in range(2, n)])
    code = F.when(F.col("line_error").isNotNull(), F.col("line_error")).when(F.col("kind") == "comment", "COMMENT_DATA_SHAPED").when(F.size("fields") != n, "FIELD_COUNT").when((value(0) == "") | (F.octet_length(value(0)) > MAX_GROUP_BYTES), "BAD_GROUP").when(parse_number(value(1)).isNull(), "BAD_INTERCEPT").when(F.exists(coef, lambda c: c.isNull()), "BAD_COEF")
    parsed = rows.select("row_id", value(0).alias("group"), parse_number(value(1)).alias("intercept"), coef.alias("coef"), code.alias("code"), "line")
    per = parsed.groupBy("group").agg(F.count("*").alias("n"), F.min("row_id").alias("r"))
    bad = parsed.agg(F.min_by(F.struct("code", "line"), F.when(F.col("code").isNotNull(), F.col("row_id")))).first()[0]
    if bad and bad["code"]:
        raise FitError(bad["code"], f"{what}: {bad['line'][:60]}")
    twice = per.where("n > 1").agg(F.min_by("group", "r")).first()[0]
    if twice is not None:
        raise FitError("GROUP_DUPLICATE", f"{what} names group {twice!r} twice")
    return Model(terms, said, parsed.select("group", "intercept", "coef", F.col("row_id").alias("first")))


def trims_from(lines: DataFrame, what: str = "the trim table", max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """(group, trim_addition, row_id). The header may be missing: a first line of two fields whose second is a number is data."""
    lines = logical_lines(lines, max_line_bytes).where((F.col("kind") == "data") | F.col("line_error").isNotNull()).withColumn("fields", fields(F.col("line")))
    number = parse_number(F.try_element_at("fields", F.lit(2)))
    first = lines.agg(F.min("row_id")).first()[0]
    if first is None:
        raise FitError("TRIM_EMPTY", f"{what} has no rows")
    head = (F.col("row_id") == first) & ~((F.size("fields") == 2) & number.isNotNull())
    rows = lines.where(~head)
    code = F.when(F.col("line_error").isNotNull(), F.col("line_error")).when(F.size("fields") != 2, "TRIM_FIELDS").when(number.isNull(), "BAD_TRIM")
    bad = rows.agg(F.min_by(F.struct(code.alias("code"), "line"), F.when(code.isNotNull(), F.col("row_id")))).first()[0]
    if bad and bad["code"]:
        raise FitError(bad["code"], f"{what}: {bad['line'][:60]}")
    return rows.select(F.try_element_at("fields", F.lit(1)).alias("group"), number.alias("trim_addition"), "row_id")


def read_trims(spark: SparkSession, path: str, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    return trims_from(read_lines(spark, path), path, max_line_bytes)


def cases_from(lines: DataFrame, terms: list[str] | tuple[str, ...], max_line_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(cases: row_id, group, x; refused: row_id, line, refusal) of lines group,x1,x2,... A line of spaces alone is no blank line here but a row with too few fields; comments are skipped whatever their shape."""
    raw = F.regexp_replace("value", r"\r\z", "")
    kept = logical_lines(lines.where((raw != "") & ~F.startswith(raw, F.lit("#")) & ~F.startswith(raw, F.lit(BOM + "#"))), max_line_bytes).withColumn("kind", F.lit("data"))
    parsed = parse_rows(kept, ["group", *terms], None)
    return parsed.where("refusal is null").select("row_id", "group", "x"), parsed.where("refusal is not null").select("row_id", "line", "refusal")
