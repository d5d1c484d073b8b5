"""Bioclimatic indicators from monthly climate grids, on Spark."""

__version__ = "0.1.0"
