"""Linear work on the arrays inside a row.  All of it is JVM built-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def runs(items: Column, starts: Callable[[Column, Column, Column], Column]) -> Column:
    """Cut an array before every element for which ``starts(array, element, index)`` holds.

    Elements before the first such one are left out.  On a sorted array this groups
    by the sort key in one pass, where a filter per group would read everything again.
    """
    def cut(a: Column) -> Column:
        first = F.filter(F.transform(a, lambda x, i: F.when(starts(a, x, i), i + 1)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda s, i: F.slice(
            a, s, F.coalesce(F.get(at, i + 1), F.size(a) + 1) - s)))

    return let(items, cut)


def new_value(field: str) -> Callable[[Column, Column, Column], Column]:
    """Start of a run of equal values of a struct field that is never null."""
    return lambda a, x, i: (i == 0) | (F.get(a, i - 1)[field] != x[field])
