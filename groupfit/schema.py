"""Which columns are the group, the response and the terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import FitError

MAX_TERMS = 256
MAX_GROUP_BYTES = 31
MAX_NAME_BYTES = 63
MAX_FIELDS = 512
#: Longest line of text that is read, in bytes.
MAX_LINE_BYTES = 17_793


def fold(name: str) -> str:
    """A name as names are compared: ASCII letters without case, all else as it is."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def fold_column(name: Column) -> Column:
    """`fold` of a column."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_terms(terms: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    if not 1 <= len(terms) <= MAX_TERMS:
        raise FitError("BAD_TERMS", f"{len(terms)} terms; from 1 to {MAX_TERMS} can be fitted")
    for t in terms:
        if not t or len(t.encode()) > MAX_NAME_BYTES:
            raise FitError("BAD_TERMS", f"a term's name is empty or longer than {MAX_NAME_BYTES} bytes: {t[:24]!r}")
    if len({fold(t) for t in terms}) < len(terms):
        raise FitError("BAD_TERMS", "two terms have the same name, ignoring case")
    return tuple(terms)


@dataclass(frozen=True)
class FitSchema:
    """Names of a training table's columns. Column order is term order."""

    group: str
    response: str
    terms: tuple[str, ...]

    @classmethod
    def of(cls, columns: list[str], response: str | None = None) -> FitSchema:
        """The first column is the group; the response is the second or the one named; all others are terms."""
        if len(columns) < 3:
            raise FitError("HEADER_TOO_NARROW", f"a group, a response and at least one term are needed; there are {len(columns)} columns")
        at = 1
        if response is not None:
            found = [k for k, c in enumerate(columns) if fold(c) == fold(response)]
            if not found:
                raise FitError("RESPONSE_UNKNOWN", f"has no column {response!r}; the columns are {', '.join(columns)}")
            at = found[0]
            if at == 0:
                raise FitError("RESPONSE_IS_GROUP", f"{response!r} cannot be predicted: the first column is the group")
        terms = [c for k, c in enumerate(columns) if k not in (0, at)]
        check_terms([*terms, columns[at]])
        return cls(columns[0], columns[at], check_terms(terms))

    @property
    def p(self) -> int:
        return len(self.terms)

    def reading(self) -> str:
        """What the columns were taken for, so that a mistake shows."""
        other = self.p
        return f"reading: column 1 is the group, '{self.response}' is the value being predicted, and the other {other} {'column is a term' if other == 1 else 'columns are terms'}"

    def training(self, df: DataFrame, group: str | None = None) -> DataFrame:
        """(group, y, x) of a training table; `group` keeps one group, or pools all rows as '*'."""
        names = {fold(c): c for c in df.columns}

        def number(name: str) -> Column:
            return df[names[fold(name)]].cast("double")

        key = F.lit("*") if group == "*" else df[names[fold(self.group)]].cast("string")
        out = df.select(key.alias("group"), number(self.response).alias("y"), F.array(*[number(t) for t in self.terms]).alias("x"))
        return out if group in (None, "*") else out.where(F.col("group") == group)
