"""Quarters of long tables (one row per pixel and month), by window frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .months import missing_to_null

#: Indicators of quarters: the series that is averaged, the series that picks the quarter, and how.
QUARTERS = {
    "bio08": ("tas", "pr", "max"), "bio09": ("tas", "pr", "min"), "bio10": ("tas", "tas", "max"), "bio11": ("tas", "tas", "min"),
    "bio16": ("pr", "pr", "max"), "bio17": ("pr", "pr", "min"), "bio18": ("pr", "tas", "max"), "bio19": ("pr", "tas", "min"),
}
STARTS = {"wettest": ("pr", "max"), "driest": ("pr", "min"), "warmest": ("tas", "max"), "coldest": ("tas", "min")}


def quarters_long(df: DataFrame, id_col: str = "pixel_id", month_col: str = "month", tas_col: str = "tas", pr_col: str = "pr", kind: str = "double") -> DataFrame:
    """One row per pixel: the first month (from 0) of its wettest, driest, warmest and coldest quarter, and the eight indicators of quarters.

    January and February are appended as months 13 and 14, and a frame over a month and
    the two after it gives the sums of the twelve circular quarters; it goes by month
    numbers, so that an absent month is a gap and moves no other. A start is missing if
    a month of its series is, a mean also if a month of the averaged series in that
    quarter is; of equal quarters the earliest counts. Of several rows for one pixel and
    month the largest value of each series counts; months outside 1..12 are ignored. All
    steps share one shuffle, by pixel.
    """
    rows = df.where(F.col(month_col).between(1, 12)).select(F.col(id_col).alias("pixel_id"), F.col(month_col).cast("int").alias("month"), missing_to_null(F.col(tas_col), kind).alias("tas"), missing_to_null(F.col(pr_col), kind).alias("pr"))
    rows = rows.repartition("pixel_id").groupBy("pixel_id", "month").agg(F.max("tas").alias("tas"), F.max("pr").alias("pr"))
    again = F.when(F.col("month") <= 2, F.array("month", F.col("month") + 12)).otherwise(F.array("month"))
    rows = rows.select("pixel_id", F.explode(again).alias("month"), "tas", "pr")
    frame = Window.partitionBy("pixel_id").orderBy("month").rangeBetween(0, 2)
    whole = Window.partitionBy("pixel_id")
    own = F.col("month") <= 12

    def quarter(s: str) -> Column:
        return F.when(F.count(s).over(frame) == 3, F.sum(s).over(frame)).alias(f"{s}_q")

    def complete(s: str) -> Column:
        return (F.count(F.when(own, F.col(s))).over(whole) == 12).alias(f"{s}_all")

    rows = rows.select("pixel_id", "month", *[f(s) for s in ("tas", "pr") for f in (quarter, complete)]).where(own)

    def picked(value: Column, by: str, how: str) -> Column:
        # of equal sums the earliest month: the largest negative, or the least
        rank = F.struct(F.col(f"{by}_q"), -F.col("month") if how == "max" else F.col("month"))
        return (F.max_by if how == "max" else F.min_by)(value, F.when(F.col(f"{by}_all"), rank))

    starts = [picked(F.col("month") - 1, *by).cast("int").alias(n) for n, by in STARTS.items()]
    means = [(picked(F.col(f"{s}_q"), *by) / F.lit(3)).cast(kind).alias(n) for n, (s, *by) in QUARTERS.items()]
    return rows.groupBy("pixel_id").agg(*starts, *means)
