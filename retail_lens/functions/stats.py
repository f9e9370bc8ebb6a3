"""Statistics whose definitions differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quartile_exclusive(values: Column, i: int, digits: int = 2) -> Column:
    """The i-th exclusive quartile, at position i (n + 1) / 4, of a sorted array; of under four values the least, median or greatest."""
    n = F.size(values)
    at = lambda k: F.get(values, k)
    j = F.least(F.greatest(F.floor(F.lit(i) * (n + 1) / 4).cast("int"), F.lit(1)), n - 1)
    d = F.lit(i) * (n + 1) - 4 * j
    few = {1: at(F.lit(0)), 2: (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2, 3: at(n - 1)}[i]
    return F.when(n == 0, None).when(n < 4, few).otherwise(F.round((at(j - 1) * (4 - d) + at(j) * d) / 4, digits))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b, null where b is 0."""
    return F.round(a / F.nullif(b, F.lit(0)), digits)
