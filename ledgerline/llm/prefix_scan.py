"""Running combinations over an array column, in DataFrame functions only.

``aggregate`` with a growing list copies the list at every element. Here the array is cut into blocks of the square
root of its length: each block is scanned by itself, then the blocks' totals, so n elements cost n to the power 1.5
small copies at worst instead of n squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixes(values: Column, zero: Column, combine: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each element the combination of all before it (``zero`` for the first); an empty array for no elements.

    ``combine`` is associative, ``zero`` its neutral element, ``kind`` the SQL type of both. A NULL array gives NULL.
    """
    nothing = F.array().cast(f"array<{kind}>")
    start = F.struct(zero.cast(kind).alias("total"), nothing.alias("before"))

    def step(acc, v):
        return F.struct(combine(acc["total"], v).cast(kind).alias("total"),
                        F.concat(acc["before"], F.array(acc["total"])).alias("before"))

    def whole(vs):
        width = F.ceil(F.sqrt(F.size(vs).cast("double"))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(vs), width)
        scanned = F.transform(firsts, lambda f: F.aggregate(F.slice(vs, f, width), start, step))

        def joined(blocks):
            totals = F.aggregate(F.transform(blocks, lambda b: b["total"]), start, step)["before"]
            return F.flatten(F.zip_with(blocks, totals,
                                        lambda b, t: F.transform(b["before"], lambda v: combine(t, v).cast(kind))))

        return let(scanned, joined)

    return let(values, lambda vs: F.when(F.size(vs) > 0, whole(vs)).when(vs.isNotNull(), nothing))


def running_sums(sizes: Column) -> Column:
    """Sums of all sizes (int) before each element."""
    return prefixes(sizes, F.lit(0), lambda a, b: a + b, "int")
