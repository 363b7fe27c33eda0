"""Expressions on arrays whose work grows with the number of elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are run through at a time.
PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, add: Callable[[Column, Column], Column], part_size: int | None = None) -> Column:
    """For each of some ints, what ``add`` makes of 0 and all ints in front of it, as one array.

    Arrays can only grow by copying, so the values are run through in parts of PART: first the
    parts' totals, then every part from its own start. The work grows with the number of values.
    """
    size = part_size or PART

    def body(v: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))
        part = lambda c: F.slice(v, c * size + 1, F.lit(size))
        grow = lambda values, first: F.aggregate(
            values, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"],
        )
        totals = F.transform(parts, lambda c: F.aggregate(part(c), F.lit(0), add))
        return let(grow(totals, F.lit(0)), lambda first: F.flatten(F.transform(parts, lambda c: grow(part(c), F.get(first, c)))))

    return let(values, lambda v: F.when(F.size(v) > 0, body(v)).otherwise(F.array().cast("array<int>")))
