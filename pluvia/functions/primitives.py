"""Statistics over the twelve cells of a row; a missing month makes them missing.

All take lists of twelve columns or of twelve SQL texts (``Sql``), so wide tables,
arrays and decoded rasters share them. Sums run from left to right, which ties
between quarters depend on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


class Sql(str):
    """SQL text that combines as a column does.

    Each operation on a column is several calls to the JVM; an indicator's text is parsed there in one.
    """

    def __add__(self, other) -> Sql:
        return Sql(f"({self} + {other})")

    def __sub__(self, other) -> Sql:
        return Sql(f"({self} - {other})")

    def __mul__(self, other) -> Sql:
        return Sql(f"({self} * {other})")

    def __rmul__(self, other) -> Sql:
        return Sql(f"({other} * {self})")

    def __truediv__(self, other) -> Sql:
        return Sql(f"({self} / {other})")

    def __gt__(self, other) -> Sql:
        return Sql(f"({self} > {other})")

    def __and__(self, other) -> Sql:
        return Sql(f"({self} and {other})")

    def cast(self, kind: str) -> Sql:
        return Sql(f"cast({self} as {kind})")

    def isNotNull(self) -> Sql:  # noqa: N802, as a column names it
        return Sql(f"({self} is not null)")


Cell = Column | Sql
Series = Sequence[Cell]


def call(name: str, *args: Cell) -> Cell:
    """A built-in function of columns or of texts."""
    return F.call_function(name, *args) if isinstance(args[0], Column) else Sql(f"{name}({', '.join(map(str, args))})")


def when(condition: Cell, x: Cell) -> Cell:
    return F.when(condition, x) if isinstance(condition, Column) else Sql(f"case when {condition} then {x} end")


def row_sum(c: Series) -> Cell:
    return reduce(add, c)


def row_mean(c: Series) -> Cell:
    return row_sum(c) / 12


def _if_whole(c: Series, x: Cell) -> Cell:
    # greatest, least and array_max skip NULL, so the sum says if one is there
    return when(row_sum(c).isNotNull(), x)


def row_max(c: Series) -> Cell:
    return _if_whole(c, call("greatest", *c))


def row_min(c: Series) -> Cell:
    return _if_whole(c, call("least", *c))


def row_std(c: Series, mean: Cell | None = None) -> Cell:
    """Over the population, in two passes; ``mean`` may be a column that holds it already."""
    m = row_mean(c) if mean is None else mean
    return call("sqrt", reduce(add, [(x - m) * (x - m) for x in c]) / 12)


def elementwise_diff(a: Series, b: Series) -> list[Cell]:
    return [x - y for x, y in zip(a, b, strict=True)]


def quarter_sums(c: Series) -> list[Cell]:
    """Of the twelve windows of three months around the year."""
    return [c[i] + c[(i + 1) % 12] + c[(i + 2) % 12] for i in range(12)]


def rolling_quarter_argmax(c: Series) -> Cell:
    """The first month (from 0) of the largest window; the earliest of equal ones."""
    q = call("array", *quarter_sums(c))
    return _if_whole(c, call("array_position", q, call("array_max", q)) - 1).cast("int")


def rolling_quarter_argmin(c: Series) -> Cell:
    q = call("array", *quarter_sums(c))
    return _if_whole(c, call("array_position", q, call("array_min", q)) - 1).cast("int")


def quarter_mean(c: Series, start: Cell) -> Cell:
    """Missing if the start is, or a month of that window."""
    return call("get", call("array", *quarter_sums(c)), start) / 3
