"""Command line: 48 rasters in, 19 rasters out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import __version__
from .functions.decode import DEFAULTS
from .functions.months import SERIES
from .operators.indicators import PER_VARIABLE, STRICT
from .rasters import compute_bioclim


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pluvia", description="Nineteen bioclimatic indicators from monthly rasters.")
    for s in SERIES:
        p.add_argument(f"--{s}", nargs="+", required=True, help="12 files, or patterns that give 12")
    p.add_argument("--outdir", default=".")
    p.add_argument("--prefix", default="bio")
    p.add_argument("--tile-size", type=int, default=512, help="rows of the grid in a partition")
    p.add_argument("--raw", action="store_true", help="no scale and offset, whatever else is given")
    for s in SERIES:
        p.add_argument(f"--{s}-scale", type=float, default=DEFAULTS[s].scale)
        p.add_argument(f"--{s}-offset", type=float, default=DEFAULTS[s].offset)
    p.add_argument("--nodata", default="-9999", help="the missing mark, or 'file' for each file's own")
    p.add_argument("--nodata-policy", choices=(PER_VARIABLE, STRICT), default=PER_VARIABLE)
    p.add_argument("--strict-metadata", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        if a.tile_size <= 0:
            raise ValueError("--tile-size must be positive")
        files = {s: getattr(a, s) for s in SERIES}
        scales = {f"{s}{k}": getattr(a, f"{s}_{k.lower()}") for s in SERIES for k in ("Scale", "Offset")}
        spark = SparkSession.builder.appName("pluvia").getOrCreate()
        compute_bioclim(spark, **files, outdir=a.outdir, prefix=a.prefix, nodata_policy=a.nodata_policy, tileSize=a.tile_size, raw=a.raw, nodata=a.nodata, strictMetadata=a.strict_metadata, **scales)
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
