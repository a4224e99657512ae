"""Array helpers: bound sub-expressions and running sums inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda x, y: x + y)


def running_sums(steps: Column) -> Column:
    """Sums of an array of longs up to and with each element; sums of blocks keep this far below quadratic."""

    def sums(steps: Column) -> Column:
        def block(i: Column) -> Column:
            return F.floor(i / _BLOCK).cast("int")

        blocks = F.transform(F.sequence(F.lit(0), block(F.size(steps) - 1)), lambda b: total(F.slice(steps, b * _BLOCK + 1, _BLOCK)))

        def row(blocks: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: total(F.slice(blocks, F.lit(1), b)))
            return let(before, lambda before: F.transform(steps, lambda _, i: F.get(before, block(i)) + total(F.slice(steps, block(i) * _BLOCK + 1, i % _BLOCK + 1))))

        # Most arrays are short: without blocks each sum costs a third.
        few = F.transform(steps, lambda _, i: total(F.slice(steps, F.lit(1), i + 1)))
        return F.when(F.size(steps) <= _BLOCK, few).otherwise(let(blocks, row))

    return let(steps, sums)


def last_match(items: Column, test: Callable[[Column], Column]) -> Column:
    """The last element that passes, or null."""
    return let(F.filter(items, test), lambda found: F.get(found, F.size(found) - 1))
