"""Twelve monthly columns, and adapters between wide, array and long tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .primitives import Sql

SERIES = ("tas", "tasmax", "tasmin", "pr")
MONTHS = range(1, 13)


def column(series: str, month: int) -> str:
    return f"{series}_{month:02d}"


def months(series: str) -> list[Column]:
    """The series' twelve columns of a wide table, January first."""
    return [F.col(column(series, m)) for m in MONTHS]


def texts(series: str) -> list[Sql]:
    """The same columns as SQL text."""
    return [Sql(f"`{column(series, m)}`") for m in MONTHS]


def missing_to_null(x: Column, kind: str = "double") -> Column:
    """NULL is the only missing value within the engine; NaN becomes NULL."""
    x = x.cast(kind)
    return F.when(~F.isnan(x), x)


def long_to_wide(df: DataFrame, id_col: str = "pixel_id", month_col: str = "month", series: tuple[str, ...] = SERIES, kind: str = "double") -> DataFrame:
    """One row per pixel with twelve columns per series; absent months are NULL.

    The months are known, so no job looks for them, and partial sums leave one row
    per pixel and task before the one shuffle, which is on the pixel. Months outside
    1..12 are ignored. Of several rows for one pixel and month the largest value wins.
    """
    rows = df.select(F.col(id_col).alias("pixel_id"), F.col(month_col).alias("month"), *[missing_to_null(F.col(s), kind).alias(f"x{i}") for i, s in enumerate(series)])
    cells = [F.expr(f"max(case when month = {m} then x{i} end) as `{column(s, m)}`") for i, s in enumerate(series) for m in MONTHS]
    return rows.groupBy("pixel_id").agg(*cells)


def tables_to_wide(tables: dict[str, DataFrame], id_col: str = "pixel_id", month_col: str = "month", value_col: str = "value", kind: str = "double") -> DataFrame:
    """One row per pixel from a long table (pixel, month, value) for each series.

    The tables are united and aggregated at once, so there is one shuffle, by pixel, of
    partial rows, where joining them would take one for each and lose pixels that a table
    lacks: those are rows with NULL for that series. Of several rows for one pixel and
    month the largest value wins, months outside 1..12 are ignored, and so are rows
    without a pixel. A series without a table is an error.
    """
    if missing := set(SERIES) - set(tables):
        raise ValueError(f"no table of {sorted(missing)}")
    parts = [t.select(F.col(id_col).cast("long").alias("pixel_id"), F.lit(s).alias("series"), F.col(month_col).cast("int").alias("month"), missing_to_null(F.col(value_col), kind).alias("value")) for s, t in tables.items()]
    rows = reduce(DataFrame.union, parts).where("pixel_id is not null")
    cells = [F.expr(f"max(case when series = '{s}' and month = {m} then value end) as {column(s, m)}") for s in SERIES for m in MONTHS]
    return rows.groupBy("pixel_id").agg(*cells)


def wide_to_long(df: DataFrame, id_col: str = "pixel_id", series: tuple[str, ...] = SERIES) -> DataFrame:
    """One row per pixel and month."""
    rows = [f"struct({m} as month, {', '.join(f'`{column(s, m)}` as `{s}`' for s in series)})" for m in MONTHS]
    return df.select(F.col(id_col), F.expr(f"explode(array({', '.join(rows)})) as _m")).select(id_col, "_m.*")


def arrays_to_wide(df: DataFrame, id_col: str = "pixel_id", series: tuple[str, ...] = SERIES, kind: str = "double") -> DataFrame:
    """Arrays of exactly twelve values as columns; another length is an error when the row is read."""
    cells = []
    for s in series:
        a = f"`{s}`"
        wrong = f"cast(raise_error(concat('{s} needs 12 months, has ', cast(size({a}) as string))) as {df.schema[s].dataType.simpleString()})"
        checked = f"case when {a} is null or size({a}) = 12 then {a} else {wrong} end"
        for m in MONTHS:
            x = f"cast(get({checked}, {m - 1}) as {kind})"
            cells.append(F.expr(f"case when not isnan({x}) then {x} end as `{column(s, m)}`"))
    return df.select(F.col(id_col).alias("pixel_id"), *cells)


def wide_to_arrays(df: DataFrame, id_col: str = "pixel_id", series: tuple[str, ...] = SERIES) -> DataFrame:
    return df.select(id_col, *[F.array(*months(s)).alias(s) for s in series])


def check_wide(df: DataFrame, series: tuple[str, ...] = SERIES) -> None:
    """Raise if a series lacks one of its twelve columns."""
    there = set(df.columns)
    for s in series:
        n = sum(column(s, m) in there for m in MONTHS)
        if n != 12:
            raise ValueError(f"{s} needs 12 months, has {n}")


def complete(df: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """How many months of each series a pixel has, and whether it has all of them."""
    counts = {f"n_{s}": reduce(add, [c.isNotNull().cast("int") for c in texts(s)]) for s in series}
    whole = " and ".join(f"{c} = 12" for c in counts.values()) or "true"
    return df.selectExpr("pixel_id", *[f"{c} as `{k}`" for k, c in counts.items()], f"{whole} as complete")
