"""The nineteen indicators as one projection."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import primitives as P
from ..functions.months import SERIES, check_wide, texts
from ..functions.primitives import Sql

NAMES = tuple(f"bio{i:02d}" for i in range(1, 20))
PER_VARIABLE, STRICT = "per_variable", "strict"


def _staged(df: DataFrame, wanted: set[str], precision: str, strict: bool) -> tuple[DataFrame, dict[str, Sql]]:
    """What several indicators share, computed once in projections below theirs.

    The first holds sums, plain extremes and the twelve quarter sums of either
    series, the second the extreme quarters. A quarter's own extreme needs no search
    for its month: the mean of the wettest quarter's rain is the largest sum over three.
    """
    tas, tasmax, tasmin, pr = (texts(s) for s in SERIES)
    temps, rains = {"bio08", "bio09", "bio10", "bio11", "bio18", "bio19"}, {"bio08", "bio09", "bio16", "bio17", "bio18", "bio19"}
    first = {
        "_whole": (wanted if strict else set(), lambda: reduce(and_, [P.row_sum(texts(name)).isNotNull() for name in SERIES])),
        "_tas_sum": ({"bio01", "bio04", *temps}, lambda: P.row_sum(tas)),
        "_pr_sum": ({"bio12", "bio13", "bio14", "bio15", *rains}, lambda: P.row_sum(pr)),
        "_bio02": ({"bio02", "bio03"}, lambda: P.row_mean(P.elementwise_diff(tasmax, tasmin)).cast(precision)),
        "_bio05": ({"bio03", "bio05", "bio07"}, lambda: P.row_max(tasmax)),
        "_bio06": ({"bio03", "bio06", "bio07"}, lambda: P.row_min(tasmin)),
        **{f"_tas_q{i}": (temps, lambda x=x: x) for i, x in enumerate(P.quarter_sums(tas))},
        **{f"_pr_q{i}": (rains, lambda x=x: x) for i, x in enumerate(P.quarter_sums(pr))},
    }

    def extreme(series: str, of: str) -> Sql:
        return P.when(Sql(f"_{series}_sum").isNotNull(), P.call(of, *_quarters(series)))

    second = {
        "_tas_mean": ({"bio01", "bio04"}, lambda: (Sql("_tas_sum") / 12).cast(precision)),
        "_pr_mean": ({"bio15"}, lambda: (Sql("_pr_sum") / 12).cast(precision)),
        "_wettest": ({"bio08", "bio16"}, lambda: extreme("pr", "greatest")),
        "_driest": ({"bio09", "bio17"}, lambda: extreme("pr", "least")),
        "_warmest": ({"bio10", "bio18"}, lambda: extreme("tas", "greatest")),
        "_coldest": ({"bio11", "bio19"}, lambda: extreme("tas", "least")),
    }
    names: list[str] = []
    for shared in (first, second):
        need = {k: make() for k, (users, make) in shared.items() if users & wanted}
        df = df.selectExpr("*", *[f"{c} as {k}" for k, c in need.items()])
        names += need
    return df, {k: Sql(k) for k in names}


def _quarters(series: str) -> list[Sql]:
    return [Sql(f"_{series}_q{i}") for i in range(12)]


def _there(value: Sql, series: str, other: str) -> Sql:
    """The mean of ``other`` over the first quarter in which ``series`` sums to ``value``."""
    at = P.call("array_position", P.call("array", *_quarters(series)), value) - 1
    return P.call("get", P.call("array", *_quarters(other)), at.cast("int")) / 3


#: The indicators that need each series.
_USERS = {
    "tas": {"bio01", "bio04", "bio08", "bio09", "bio10", "bio11", "bio18", "bio19"},
    "tasmax": {"bio02", "bio03", "bio05", "bio07"},
    "tasmin": {"bio02", "bio03", "bio06", "bio07"},
    "pr": {"bio08", "bio09", *NAMES[11:]},
}


def series_of(outputs: Iterable[str], nodata_policy: str = PER_VARIABLE) -> tuple[str, ...]:
    """The series that the named indicators need."""
    wanted = set(outputs)
    return tuple(s for s in SERIES if nodata_policy == STRICT or _USERS[s] & wanted)


def bioclim(df: DataFrame, outputs: Iterable[str] = NAMES, nodata_policy: str = PER_VARIABLE, precision: str = "double", keep: Iterable[str] = ("pixel_id",)) -> DataFrame:
    """``keep`` and the named indicators of each pixel of a wide table.

    A narrow projection: no shuffle, and columns that no named indicator needs
    aren't read. Missing values are NULL. With ``per_variable`` an indicator is
    missing if its own inputs are; with ``strict`` all are missing if any of the 48
    months is. ``float`` computes and returns single precision. Inputs must be
    finite: the month tables' adapters turn NaN into NULL.
    """
    outputs = list(outputs)
    if unknown := set(outputs) - set(NAMES):
        raise ValueError(f"no such indicator: {sorted(unknown)}")
    if nodata_policy not in (PER_VARIABLE, STRICT):
        raise ValueError(f"no such policy: {nodata_policy}")
    if precision not in ("double", "float"):
        raise ValueError(f"no such precision: {precision}")
    wanted = set(outputs)
    check_wide(df, series_of(outputs, nodata_policy))
    staged, s = _staged(df, wanted, precision, nodata_policy == STRICT)
    tas, pr = texts("tas"), texts("pr")

    def ratio(a: Sql, b: Sql) -> Sql:
        return 100 * a / P.call("nullif", b, Sql(0).cast(precision))

    rules = {
        "bio01": lambda: s["_tas_mean"],
        "bio02": lambda: s["_bio02"],
        "bio03": lambda: ratio(s["_bio02"], s["_bio05"] - s["_bio06"]),
        "bio04": lambda: 100 * P.row_std(tas, s["_tas_mean"]),
        "bio05": lambda: s["_bio05"],
        "bio06": lambda: s["_bio06"],
        "bio07": lambda: s["_bio05"] - s["_bio06"],
        "bio08": lambda: _there(s["_wettest"], "pr", "tas"),
        "bio09": lambda: _there(s["_driest"], "pr", "tas"),
        "bio10": lambda: s["_warmest"] / 3,
        "bio11": lambda: s["_coldest"] / 3,
        "bio12": lambda: s["_pr_sum"],
        "bio13": lambda: P.when(s["_pr_sum"].isNotNull(), P.call("greatest", *pr)),
        "bio14": lambda: P.when(s["_pr_sum"].isNotNull(), P.call("least", *pr)),
        "bio15": lambda: P.when(s["_pr_mean"] > 0, ratio(P.row_std(pr, s["_pr_mean"]), s["_pr_mean"])),
        "bio16": lambda: s["_wettest"] / 3,
        "bio17": lambda: s["_driest"] / 3,
        "bio18": lambda: _there(s["_warmest"], "tas", "pr"),
        "bio19": lambda: _there(s["_coldest"], "tas", "pr"),
    }
    cells = {n: rules[n]() for n in outputs}
    if nodata_policy == STRICT:
        cells = {n: P.when(s["_whole"], c) for n, c in cells.items()}
    return staged.select(*keep, *[F.expr(f"{c.cast(precision)} as {n}") for n, c in cells.items()])
