"""48 small uniform rasters to try the engine with: ``python -m pluvia.tools.sample FOLDER``."""

from __future__ import annotations

import argparse
import os

import numpy as np

from ..functions.months import MONTHS, SERIES
from ..sources import tiff

WIDTH = HEIGHT = 10
#: Cells of 36 by 18 degrees from the upper left corner of the world.
GEO = ((36.0, 18.0, 0.0), (0.0, 0.0, 0.0, -180.0, 90.0, 0.0), tiff.EPSG_4326)
#: A month's value is its number and this.
SHIFT = {"tas": 0, "tasmax": 1, "tasmin": -1, "pr": 0}


def write(folder: str, width: int = WIDTH, height: int = HEIGHT) -> dict[str, list[str]]:
    """The files of each series, January first."""
    os.makedirs(folder, exist_ok=True)
    out: dict[str, list[str]] = {}
    for s in SERIES:
        for m in MONTHS:
            image = np.full((height, width), m + SHIFT[s], "f4")
            out.setdefault(s, []).append(f"{folder}/{s}_{m:02d}.tif")
            tiff.write_cog(out[s][-1], lambda y, h, image=image: image[y : y + h], width, height, GEO, nodata=-9999.0)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pluvia.tools.sample", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--width", type=int, default=WIDTH)
    p.add_argument("--height", type=int, default=HEIGHT)
    a = p.parse_args(argv)
    print(sum(map(len, write(a.folder, a.width, a.height).values())), "files")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
