"""From stored integers to values: missing mark, scale and offset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999


@dataclass(frozen=True)
class Scale:
    scale: float = 1.0
    offset: float = 0.0


RAW = Scale()
#: Tenths of a kelvin, and tenths of a millimetre.
TEMPERATURE = Scale(0.1, -273.15)
PRECIPITATION = Scale(0.1, 0.0)
DEFAULTS = {"tas": TEMPERATURE, "tasmax": TEMPERATURE, "tasmin": TEMPERATURE, "pr": PRECIPITATION}


def masked(raw: Column, nodata: float | None = NODATA) -> Column:
    """NULL where the stored value is the missing mark; it is compared before scaling."""
    return raw if nodata is None else F.when(raw != F.lit(nodata), raw)


def decoded(raw: Column, by: Scale = RAW, nodata: float | None = NODATA) -> Column:
    """The stored value times scale plus offset, in single precision."""
    return masked(raw, nodata).cast("float") * F.lit(by.scale).cast("float") + F.lit(by.offset).cast("float")
