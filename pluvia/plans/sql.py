"""The indicators from SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..operators.indicators import NAMES, PER_VARIABLE, STRICT, bioclim
from .session import tuned

POLICIES = (PER_VARIABLE, STRICT)


def register_bioclim(pixels: DataFrame, function: str = "bioclim", keep: Iterable[str] = ("pixel_id",), precision: str = "double") -> None:
    """A table function over a wide table of pixels: ``SELECT pixel_id, bio12 FROM bioclim()``, or ``bioclim('strict')``.

    It returns ``keep`` and the nineteen indicators, and lives as long as the session.
    The function is a query, which Spark puts in place of the call; so a query that names
    few indicators computes those and reads their columns only, and the policy, a
    constant, leaves the plan. Another policy gives no rows. A second call replaces the
    function.
    """
    spark = tuned(pixels.sparkSession)
    keep = list(keep)
    parts = []
    for policy in POLICIES:
        view = f"{function}_{policy}"
        bioclim(pixels, NAMES, policy, precision, keep).createOrReplaceTempView(view)
        parts.append(f"SELECT * FROM {view} WHERE policy = '{policy}'")
    kinds = {f.name: f.dataType.simpleString() for f in spark.table(f"{function}_{PER_VARIABLE}").schema}
    cells = ", ".join(f"`{n}` {t}" for n, t in kinds.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(policy STRING DEFAULT '{PER_VARIABLE}') RETURNS TABLE ({cells}) RETURN {' UNION ALL '.join(parts)}")
