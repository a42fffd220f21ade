"""Array columns: values used several times, and running sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, add, nothing: int = 0) -> Column:
    """add() over all elements up to each: after step k every element covers 2 ** k of them."""

    def step(a: Column, k: Column) -> Column:
        late = F.slice(F.concat(F.array_repeat(F.lit(nothing), F.call_function("shiftleft", F.lit(1), k)), a), F.lit(1), F.size(a))
        return F.zip_with(a, late, add)

    steps = lambda a: F.when(F.size(a) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return once(values, lambda a: F.aggregate(steps(a), a, step))
