"""Column helpers for work inside one row."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def starts(lengths: Column, places: Column, block: int = 256) -> Column:
    """For each of ``places`` (from 0): the sum of the lengths before it.

    Sums go by blocks, so the work is far from the square of the number of lengths.
    """
    def within(sums: Column) -> Column:
        prefix = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda c: total(F.slice(sums, F.lit(1), c)))
        return let(prefix, lambda before: F.transform(
            places,
            lambda i: F.get(before, F.floor(i / block).cast("int"))
            + total(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block)),
        ))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
    return let(F.transform(blocks, lambda c: total(F.slice(lengths, c * block + 1, F.lit(block)))), within)
