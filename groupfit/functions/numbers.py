"""Numbers in and out of text, and rounding as part of the answer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..errors import FitError

#: What counts as a number: decimal digits with an optional exponent. White space may lead; only spaces may trail.
NUMBER = r"^[ \t\n\x0B\f\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$"

MAX_DOUBLE = 1.7976931348623157e308


def parse_number(text: Column) -> Column:
    """The double that a text spells, null if it spells none: no hex, no nan or inf, nothing that overflows."""
    value = F.when(text.rlike(NUMBER), F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", "").try_cast("double"))
    return F.when(F.abs(value) <= MAX_DOUBLE, value)


def check_scale(scale: int | str) -> int:
    """A number of decimals from 0 to 9."""
    try:
        if isinstance(scale, bool) or (isinstance(scale, str) and not (scale.isascii() and scale.isdigit())) or int(scale) != float(scale):
            raise ValueError
        value = int(scale)
    except (ValueError, TypeError):
        raise FitError("BAD_SCALE", f"{scale!r} is not a whole number of decimals") from None
    if not 0 <= value <= 9:
        raise FitError("BAD_SCALE", f"{value} decimals; from 0 to 9 can be kept")
    return value


def round_half_away(value: Column, scale: int) -> Column:
    """value rounded to `scale` decimals in binary arithmetic, halves away from zero.

    round() at scale 0 after the multiplication: round(value, scale) goes by the decimal digits and differs. Values that would overflow stay as they are.
    """
    factor = float(10**scale)
    return F.when(F.isnan(value) | (F.abs(value) > MAX_DOUBLE / factor), value).otherwise(F.round(value * factor, 0) / factor)


def predict(intercept: Column, coef: Column, x: Column) -> Column:
    """intercept + sum of coef * x, left to right."""
    return F.aggregate(F.zip_with(coef, x, lambda b, v: b * v), intercept, lambda a, v: a + v)


def trim_point(prediction: Column, addition: Column, scale: int, trim_scale: int) -> Column:
    """The trim point stands on the rounded prediction."""
    return round_half_away(round_half_away(prediction, scale) + addition, trim_scale)


def printed(value: Column, form: str) -> Column:
    """Text of a double as C's printf writes it with `form`: the exact binary value is rounded, ties to even. The JVM's formats round the shortest decimal instead.

    In Arrow batches; for lines of text that leave the engine.
    """

    def text(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else form % x for x in column.to_pylist()], pa.string())

    return arrow_udf(text, "string")(value)


def significant(value: Column, digits: int = 12) -> Column:
    """Text as %.<digits>g writes it: significant digits without trailing zeros, an exponent where it is below -4 or from `digits` on."""
    return printed(value, f"%.{digits}g")
