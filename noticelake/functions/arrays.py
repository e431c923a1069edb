"""Array expressions that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often the lambdas in ``use`` read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    # each round joins an element with the one 1, 2, 4, ... places before it: n log n steps, no array grows
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")))

    def one(out: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(out, lambda x, i: F.when(i >= back, join(x, F.get(out, i - back))).otherwise(x))

    return F.aggregate(rounds, values, one)


def running_sums(values: Column) -> Column:
    """Sums of the elements up to each place, itself included."""
    return _running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return _running(values, F.greatest)
