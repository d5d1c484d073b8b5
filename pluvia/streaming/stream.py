"""The same projection over a stream of pixels; it keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.months import arrays_to_wide
from ..operators.indicators import bioclim


def bioclim_stream(pixels: DataFrame, **options) -> DataFrame:
    """Indicators of a stream (or table) of pixels with four arrays of twelve months."""
    return bioclim(arrays_to_wide(pixels), **options)


def read_pixels(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 1000) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
