"""Array expressions that stay in their row (built-ins only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of an array's elements (of type ``kind``) from the left.
    ``combine(before, x)`` is associative and takes a null ``before`` for nothing.  Each
    pass joins elements twice as far apart, so n elements take log2(n) passes and no
    accumulator grows element by element."""
    def scan(v: Column) -> Column:
        n = F.size(v)
        last = F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int") - 1, F.lit(0))

        def step(acc: Column, k: Column) -> Column:
            far = F.pow(F.lit(2), k).cast("int")
            ahead = F.concat(F.array_repeat(F.lit(None).cast(kind), far), F.slice(acc, F.lit(1), F.greatest(n - far, F.lit(0))))
            return F.zip_with(ahead, acc, combine)

        return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), last), v, step)).otherwise(v)

    return bind(values, scan)


def blocks(values: Column, size: int) -> Column:
    """The array in pieces of ``size``."""
    n = F.ceil(F.size(values) / F.lit(size)).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda b: F.slice(values, (b - 1) * size + 1, F.lit(size)))
