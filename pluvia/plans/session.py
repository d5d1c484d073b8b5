"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tuned(spark: SparkSession) -> SparkSession:
    """Keep generated methods small enough for the JIT compiler.

    The fused projection of all indicators is larger than the 8,000 bytecodes beyond
    which HotSpot doesn't compile a method. With this limit Spark falls back to
    separate projections there, which is about ten times as fast. The setting is the
    session's and must hold when an action runs, so it can't be put back here.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark
