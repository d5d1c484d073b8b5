"""Pixel-by-month views over the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import MONTHS, SERIES, column


@dataclass(frozen=True)
class View:
    table: str
    pixel: str
    month: str
    value: str
    #: The rain series: the sum of the values, or their number.
    pr: str


#: Fractional values are summed as integer cents, so that no order of addition shows.
VIEWS = {
    "px_supplier": View("lineitem", "l_suppkey", "month(l_shipdate)", "l_quantity", "sum"),
    "px_part": View("lineitem", "l_partkey", "month(l_shipdate)", "l_quantity", "sum"),
    "px_customer": View("orders", "o_custkey", "month(o_orderdate)", "round(100 * o_totalprice)", "count"),
    "px_user": View("events", "user_id", "cast(floor(hour(ts) / 2) as int) + 1", "round(100 * value)", "count"),
}


def _cells(v: View, month: int) -> dict[str, str]:
    x = f"case when {v.month} = {month} then cast({v.value} as double) end"
    return {
        "tas": f"sum({x}) / nullif(count({x}), 0)",
        "tasmax": f"max({x})",
        "tasmin": f"min({x})",
        "pr": f"sum({x})" if v.pr == "sum" else f"cast(nullif(count({x}), 0) as double)",
    }


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One row per pixel, straight from the table in one aggregation."""
    v = VIEWS[name]
    cells = [F.expr(f"{x} as {column(s, m)}") for m in MONTHS for s, x in _cells(v, m).items()]
    return spark.read.parquet(f"{sf_dir}/{v.table}.parquet").groupBy(F.col(v.pixel).cast("long").alias("pixel_id")).agg(*cells)


def long(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One row per pixel and month that has values."""
    v = VIEWS[name]
    x = F.expr(f"cast({v.value} as double)")
    rows = spark.read.parquet(f"{sf_dir}/{v.table}.parquet").select(F.col(v.pixel).cast("long").alias("pixel_id"), F.expr(v.month).cast("int").alias("month"), x.alias("x"))
    pr = F.sum("x") if v.pr == "sum" else F.count("x").cast("double")
    return rows.groupBy("pixel_id", "month").agg((F.sum("x") / F.count("x")).alias("tas"), F.max("x").alias("tasmax"), F.min("x").alias("tasmin"), pr.alias("pr"))


def wide_sql(name: str) -> str:
    v = VIEWS[name]
    cells = [f"{x} as {column(s, m)}" for m in MONTHS for s, x in _cells(v, m).items()]
    return f"select cast({v.pixel} as bigint) as pixel_id, {', '.join(cells)} from {v.table} group by {v.pixel}"


def long_sql(name: str) -> str:
    v = VIEWS[name]
    pr = "sum(x)" if v.pr == "sum" else "cast(count(x) as double)"
    return (
        f"select pixel_id, month, sum(x) / count(x) as tas, max(x) as tasmax, min(x) as tasmin, {pr} as pr from (select cast({v.pixel} as bigint) as pixel_id, "
        f"cast({v.month} as int) as month, cast({v.value} as double) as x from {v.table}) group by pixel_id, month"
    )


__all__ = ["SERIES", "VIEWS", "long", "long_sql", "wide", "wide_sql"]
