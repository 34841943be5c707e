"""Array expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Elements that are summed in one run.
FEW = 48


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row.

    A column that only a lambda refers to is otherwise folded into it by the optimizer and computed for every element.
    """
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


Op = Callable[[Column, Column], Column]


def _before(arr: Column, op: Op, kind: str) -> Column:
    """struct(sums, total): op over the elements before each one, and over all; copies grow with the square, so for short arrays."""
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("sums"), F.lit(0).cast(kind).alias("total"))
    return F.aggregate(arr, zero, lambda s, x: F.struct(F.array_append(s["sums"], s["total"]).alias("sums"), op(s["total"], x).cast(kind).alias("total")))


def running(arr: Column, op: Op, kind: str = "int") -> Column:
    """For an array of kind: op over all elements before each one, in time that grows with the size.

    op is associative and 0 is neutral to it. Runs of FEW elements are added up one by one; the runs' totals are doubled up.
    """
    return let(arr, lambda a: F.when(F.size(a) <= FEW, _before(a, op, kind)["sums"]).otherwise(_running(a, op, kind)))


def _running(arr: Column, op: Op, kind: str) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(arr), F.lit(1)) - 1, F.lit(FEW)), lambda i: _before(F.slice(arr, i + 1, F.lit(FEW)), op, kind))
    ahead = lambda r: _doubled(F.transform(r, lambda x: x["total"]), op, kind)
    return let(runs, lambda r: F.flatten(F.zip_with(r, ahead(r), lambda x, a: F.transform(x["sums"], lambda s: op(a, s)))))


def _doubled(arr: Column, op: Op, kind: str) -> Column:
    """op over the elements before each one: after k steps each place holds that over the 2**k elements before it."""
    zero = F.lit(0).cast(kind)

    def step(a: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        back = F.concat(F.array_repeat(zero, F.least(reach, F.size(a))), F.slice(a, F.lit(1), F.greatest(F.size(a) - reach, F.lit(0))))
        return F.zip_with(a, back, lambda x, y: op(y, x).cast(kind))

    shifted = F.concat(F.array(zero), F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0))))
    steps = F.ceil(F.log2(F.greatest(F.size(arr), F.lit(2)).cast("double"))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), steps - 1), shifted, step)


def offsets(lengths: Column) -> Column:
    """For array<int>: the sum of all elements before each one."""
    return running(lengths, lambda a, b: a + b)


def found(arr: Column) -> Column:
    """The elements that are not null."""
    return F.filter(arr, lambda x: x.isNotNull())
