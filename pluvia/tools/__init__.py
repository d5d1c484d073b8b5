"""Command-line helpers: sample rasters, validation, reports."""
