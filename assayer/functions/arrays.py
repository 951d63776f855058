"""Functions of arrays that stay linear, or near it, in the length of the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, also where a lambda inside `body` reads it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """Sums of the first 1, 2, … elements of an array of ints that are not negative; or what `join` makes of them (associative, 0 changes nothing).

    Appending to an array copies it, so sums over n elements at once would copy n * n; here about n ** 1.5: sums inside runs of
    sqrt(n) elements, then over the runs.
    """
    none = F.array().cast("array<int>")
    add = lambda done, x: F.concat(done, F.array(join(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)), x)))
    total = lambda run: F.aggregate(run, F.lit(0), join)

    def summed(v):
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda k: F.slice(v, k * step + 1, step))
        inside = lambda rs: let(F.aggregate(F.transform(rs, total), none, add), lambda sums: F.flatten(F.transform(rs, lambda r, k: shifted(r, sums, k))))
        return let(runs, inside)

    def shifted(run, sums, k):
        return F.transform(F.aggregate(run, none, add), lambda x: join(F.coalesce(F.get(sums, k - 1), F.lit(0)), x))

    return F.when(F.size(values) == 0, none).otherwise(let(values, summed))
