"""Checksums and layout of many rasters: ``python -m pluvia.tools.validate FOLDER``."""

from __future__ import annotations

import argparse
import glob
import hashlib
import sys

from pyspark.sql import DataFrame, SparkSession

from ..sources.tiff import cog_faults


def checked(path: str) -> tuple[str, str, str]:
    """(path, SHA-256, what is wrong with the layout; empty if nothing is)."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
        return path, digest.hexdigest(), "; ".join(cog_faults(path))
    except (OSError, ValueError, IndexError, KeyError) as e:
        return path, digest.hexdigest(), f"can't be read: {e}"


def validated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, faults) of each file, one task a file; files must be on storage that all executors mount."""

    def run(batches):
        for b in batches:
            b[["path", "sha256", "faults"]] = [checked(p) for p in b["path"]]
            yield b

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return table.mapInPandas(run, "path string, sha256 string, faults string")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pluvia.tools.validate", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--pattern", default="*.tif")
    a = p.parse_args(argv)
    paths = sorted(glob.glob(f"{glob.escape(a.folder)}/{a.pattern}"))
    if not paths:
        print(f"no files in {a.folder}", file=sys.stderr)
        return 1
    rows = sorted(map(tuple, validated(SparkSession.builder.appName("pluvia").getOrCreate(), paths).collect()))
    for path, digest, faults in rows:
        print(digest, path, faults or "ok")
    return int(any(faults for *_, faults in rows))


if __name__ == "__main__":
    raise SystemExit(main())
