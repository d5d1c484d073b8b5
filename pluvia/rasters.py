"""Indicators of rasters in one call."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions.months import SERIES, arrays_to_wide
from .operators.indicators import NAMES, PER_VARIABLE, bioclim, series_of
from .plans.session import tuned
from .sources.files import expand
from .sources.raster import inspect, read_months, write_bio

Files = str | Sequence[str] | None
#: Options of the source, in lower case.
OPTIONS = {"tilesize", "tilewidth", "raw", "nodata", "strictmetadata", *[f"{s}{k}" for s in SERIES for k in ("scale", "offset")]}


def compute_bioclim(spark: SparkSession, tas: Files = None, tasmax: Files = None, tasmin: Files = None, pr: Files = None, outdir: str | None = None, outputs: Iterable[str] = NAMES, prefix: str = "bio", nodata_policy: str = PER_VARIABLE, **options) -> DataFrame:
    """The named indicators of each pixel in single precision, and with ``outdir`` also as rasters there.

    Each series is twelve files, or patterns that give twelve, January first; those that
    no named indicator needs may be left out and aren't opened. ``options`` are those of
    the source: tileSize (rows) and tileWidth of a partition, raw, nodata (the missing
    mark, or ``file``), strictMetadata, <series>Scale and <series>Offset. A missing file,
    another number of files, files of different sizes and an unknown option raise an
    error before any task runs.
    """
    if unknown := {k for k in options if k.lower() not in OPTIONS}:
        raise ValueError(f"no such option: {sorted(unknown)}")
    outputs = list(outputs)
    series = series_of(outputs, nodata_policy)
    given = {"tas": tas, "tasmax": tasmax, "tasmin": tasmin, "pr": pr}
    files = {}
    for s in series:
        if given[s] is None:
            raise ValueError(f"{s} is needed for {outputs}")
        files[s] = expand(given[s])
        if not files[s]:
            raise ValueError(f"no file is called {given[s]}")
    grid = inspect(files, str(options.get("strictMetadata", "false")).lower() == "true", series)
    if int(options.get("tileSize", 512)) <= 0:
        raise ValueError("tileSize must be positive")
    pixels = read_months(tuned(spark), files, series, **options)
    out = bioclim(arrays_to_wide(pixels, series=series, kind="float"), outputs, nodata_policy, "float")
    if outdir is not None:
        write_bio(out, outdir, grid, prefix)
    return out
