"""Named queries over the star-schema tables, one per operator, and their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions import primitives as P
from ..functions.longform import QUARTERS, STARTS, quarters_long
from ..functions.months import MONTHS, SERIES, arrays_to_wide, column, complete, long_to_wide, months, tables_to_wide, texts, wide_to_arrays, wide_to_long
from ..operators.indicators import NAMES, STRICT, bioclim
from ..sources.files import located
from ..sources.raster import Grid, read_grid, read_months, read_rasters, write_bio, write_rasters
from ..sources.tiff import EPSG_4326
from . import oracle as O
from .session import tuned
from .sql import register_bioclim
from .views import long, long_sql, wide, wide_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PX = "px_supplier"


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def _row(name: str, cells: Callable[[], dict], sql: dict[str, str], kind: str = "double", view: str = PX) -> None:
    def query(spark, sf_dir):
        return wide(tuned(spark), sf_dir, view).select("pixel_id", *[F.expr(f"{c.cast(kind)} as {k}") for k, c in cells().items()])

    _add(name, query, O.select(sql, wide_sql(view), kind))


_row("row_mean_tas", lambda: {"mean": P.row_mean(texts("tas"))}, {"mean": O.row_mean(O.cols("tas"))})
_row("row_sum_pr", lambda: {"total": P.row_sum(texts("pr"))}, {"total": O.row_sum(O.cols("pr"))})
_row("row_max_tasmax", lambda: {"most": P.row_max(texts("tasmax"))}, {"most": O.row_max(O.cols("tasmax"))})
_row("row_min_tasmin", lambda: {"least": P.row_min(texts("tasmin"))}, {"least": O.row_min(O.cols("tasmin"))})
_row("row_std_tas", lambda: {"std": P.row_std(texts("tas"))}, {"std": O.row_std(O.cols("tas"))})
_row("row_std_pr", lambda: {"std": P.row_std(texts("pr"))}, {"std": O.row_std(O.cols("pr"))})
_row(
    "elementwise_diff",
    lambda: {f"diff_{m:02d}": x for m, x in zip(MONTHS, P.elementwise_diff(texts("tasmax"), texts("tasmin")), strict=True)},
    {f"diff_{m:02d}": x for m, x in zip(MONTHS, O.diff(O.cols("tasmax"), O.cols("tasmin")), strict=True)},
)
_row(
    "quarter_sums_circular",
    lambda: {f"q_{i:02d}": x for i, x in enumerate(P.quarter_sums(texts("pr")))},
    {f"q_{i:02d}": x for i, x in enumerate(O.quarters(O.cols("pr")))},
)
_row("quarter_argmax_pr", lambda: {"start": P.rolling_quarter_argmax(texts("pr"))}, {"start": O.arg(O.cols("pr"), "max")}, "int", "px_part")
_row("quarter_argmin_pr", lambda: {"start": P.rolling_quarter_argmin(texts("pr"))}, {"start": O.arg(O.cols("pr"), "min")}, "int", "px_part")
_row("quarter_argmax_tas", lambda: {"start": P.rolling_quarter_argmax(texts("tas"))}, {"start": O.arg(O.cols("tas"), "max")}, "int")
_row("quarter_argmin_tas", lambda: {"start": P.rolling_quarter_argmin(texts("tas"))}, {"start": O.arg(O.cols("tas"), "min")}, "int")
_row(
    "quarter_mean_wettest",
    lambda: {"mean": P.quarter_mean(texts("tas"), P.rolling_quarter_argmax(texts("pr")))},
    {"mean": O.quarter_mean(O.cols("tas"), O.arg(O.cols("pr"), "max"))},
)


def _bio(name: str, outputs: tuple[str, ...], view: str, policy: str = "per_variable") -> None:
    sql = {k: v for k, v in O.indicators().items() if k in outputs}
    if policy == STRICT:
        all_ = " and ".join(f"{O.row_sum(O.cols(s))} is not null" for s in SERIES)
        sql = {k: f"case when {all_} then {v} end" for k, v in sql.items()}
    _add(name, lambda spark, sf_dir: bioclim(wide(tuned(spark), sf_dir, view), outputs, policy), O.select(sql, wide_sql(view)))


for _n in NAMES:
    _bio(_n, (_n,), PX)
_bio("bioclim_all", NAMES, PX)
_bio("bioclim_partial_missing", NAMES, "px_part")
_bio("bioclim_strict_missing", NAMES, "px_part", STRICT)
_bio("bioclim_sparse", NAMES, "px_customer")
_bio("bioclim_events", NAMES, "px_user")

#: A gap in one series only: the mean temperature of June is struck out for every third pixel.
_GAP = "case when pixel_id % 3 = 0 then null else tas_06 end"
_add(
    "bioclim_one_gap",
    lambda spark, sf_dir: bioclim(wide(tuned(spark), sf_dir, PX).withColumn("tas_06", F.expr(_GAP))),
    O.select(O.indicators(), f"select * replace ({_GAP} as tas_06) from ({wide_sql(PX)})"),
)

# stored integers, with the missing mark in some cells
_RAW = "case when (pixel_id + month) % 7 = 0 then -9999 else cast(pr as int) end"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir, PX).select("pixel_id", "month", F.expr(_RAW).alias("raw"))


_RAW_SQL = f"select pixel_id, month, {_RAW} as raw from ({long_sql(PX)})"


def _decode(name: str, by: D.Scale) -> None:
    x = f"cast(case when raw <> -9999 then raw end as float) * cast({by.scale} as float) + cast({by.offset} as float)"
    _add(
        name,
        lambda spark, sf_dir: _raw(spark, sf_dir).select("pixel_id", "month", D.decoded(F.col("raw"), by).cast("double").alias("value")),
        f"select pixel_id, month, cast({x} as double) as value from ({_RAW_SQL})",
    )


_decode("decode_temperature", D.TEMPERATURE)
_decode("decode_precipitation", D.PRECIPITATION)
_decode("decode_raw_identity", D.RAW)
_add(
    "nodata_mask",
    lambda spark, sf_dir: _raw(spark, sf_dir).select("pixel_id", "month", D.masked(F.col("raw")).alias("value")),
    f"select pixel_id, month, case when raw <> -9999 then raw end as value from ({_RAW_SQL})",
)
#: Pixels as a grid ten cells wide, row by row; the window's cells are numbered from 0 in the same order.
_WINDOW = "pixel_id % 10 between 2 and 6 and cast(floor(pixel_id / 10) as bigint) between 1 and 4"
_PLACE = "(cast(floor(pixel_id / 10) as bigint) - 1) * 5 + pixel_id % 10 - 2"
_add(
    "read_window",
    lambda spark, sf_dir: long(spark, sf_dir, PX).where(_WINDOW).select(F.expr(_PLACE).cast("bigint").alias("cell"), "month", "pr"),
    f"select cast({_PLACE} as bigint) as cell, month, pr from ({long_sql(PX)}) where {_WINDOW}",
)
_WIDE = [column(s, m) for s in SERIES for m in MONTHS]
_add(
    "long_to_wide",
    lambda spark, sf_dir: long_to_wide(long(tuned(spark), sf_dir, "px_part")),
    f"select pixel_id, {', '.join(f'max(case when month = {m} then {s} end) as {column(s, m)}' for s in SERIES for m in MONTHS)} from ({long_sql('px_part')}) group by pixel_id",
)
_add(
    "wide_to_long",
    lambda spark, sf_dir: wide_to_long(wide(spark, sf_dir, "px_part")),
    f"with px as ({wide_sql('px_part')}) "
    + " union all ".join(f"select pixel_id, {m} as month, {', '.join(f'{column(s, m)} as {s}' for s in SERIES)} from px" for m in MONTHS),
)
_add(
    "array_input",
    lambda spark, sf_dir: bioclim(arrays_to_wide(wide_to_arrays(wide(tuned(spark), sf_dir, "px_part"))), ("bio08", "bio12")),
    O.select({k: O.indicators()[k] for k in ("bio08", "bio12")}, wide_sql("px_part")),
)
_add(
    "validate_months",
    lambda spark, sf_dir: complete(wide(tuned(spark), sf_dir, "px_customer")),
    f"with px as ({wide_sql('px_customer')}) select pixel_id, "
    + ", ".join("cast(" + " + ".join(f"({c} is not null)::int" for c in O.cols(s)) + f" as int) as n_{s}" for s in SERIES)
    + ", " + " and ".join(f"{c} is not null" for c in _WIDE) + " as complete from px",
)

# quarters of the long table, by window frames
_add(
    "quarters_long_form",
    lambda spark, sf_dir: quarters_long(long(tuned(spark), sf_dir, "px_part")),
    f"select pixel_id, {', '.join(f'cast({O.arg(O.cols(s), how)} as int) as {n}' for n, (s, how) in STARTS.items())}, {', '.join(f'cast({O.indicators()[n]} as double) as {n}' for n in QUARTERS)} from ({wide_sql('px_part')})",
)

# four tables of one series each, in which some months and some pixels of the others are absent and most months repeat
_TABLES = {"tas": ("true", "l_quantity"), "tasmax": ("l_returnflag <> 'A'", "l_quantity"), "tasmin": ("l_linestatus = 'F'", "l_quantity"), "pr": ("true", "l_linenumber")}


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tuned(spark).read.parquet(f"{sf_dir}/lineitem.parquet")
    return bioclim(tables_to_wide({s: lines.where(rows).select(F.col("l_partkey").alias("pixel_id"), F.month("l_shipdate").alias("month"), F.col(v).alias("value")) for s, (rows, v) in _TABLES.items()}))


_CELLS = ", ".join(f"max(case when month(l_shipdate) = {m} and {rows} then cast({v} as double) end) as {column(s, m)}" for s, (rows, v) in _TABLES.items() for m in MONTHS)
_add("series_tables", _tables, O.select(O.indicators(), f"select cast(l_partkey as bigint) as pixel_id, {_CELLS} from lineitem group by l_partkey"))


def _from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_bioclim(wide(tuned(spark), sf_dir, "px_part"))
    return spark.sql("SELECT a.pixel_id, a.bio12, b.bio15 FROM bioclim() a JOIN bioclim('strict') b USING (pixel_id)")


_add(
    "sql_table_function",
    _from_sql,
    f"with a as ({O.select({k: O.indicators()[k] for k in ('bio12', 'bio15')}, wide_sql('px_part'))}), b as (select pixel_id, {' and '.join(f'{c} is not null' for c in _WIDE)} as complete from ({wide_sql('px_part')})) "
    "select pixel_id, bio12, case when complete then bio15 end as bio15 from a join b using (pixel_id)",
)

# The raster source and sink: pixels go to 48 files, a grid GRID cells wide, and come back from them.
GRID = 50


def _folder(spark: SparkSession) -> str:
    """A folder that all executors reach: below ``spark.checkpoint.dir``, or a temporary one where all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        out = tempfile.mkdtemp(prefix="pluvia-rasters-")
        atexit.register(shutil.rmtree, out, ignore_errors=True)
        return out
    out = f"{root.rstrip('/')}/pluvia-rasters-{uuid.uuid4().hex}"
    store, inner = located(out)
    store.create_dir(inner, recursive=True)
    atexit.register(store.delete_dir, inner)
    return out


def _rasters(spark: SparkSession, px: DataFrame, series: tuple[str, ...] = SERIES) -> tuple[dict[str, list[str]], Grid, str]:
    """``px`` (pixel_id and twelve columns a series) as twelve files a series."""
    last = px.agg(F.max("pixel_id")).first()[0] or 0
    grid = Grid(GRID, int(last) // GRID + 1, ((0.5, 0.5, 0.0), (0.0, 0.0, 0.0, -20.0, 40.0, 0.0), EPSG_4326), None)
    out = _folder(spark)
    write_rasters(px, out, grid, {column(s, m): column(s, m) for s in series for m in MONTHS})
    return {s: [f"{out}/{column(s, m)}.tif" for m in MONTHS] for s in series}, grid, out


def _as_stored(sql: str) -> str:
    """48 columns of ``sql`` as single precision, which files hold."""
    return f"select pixel_id, {', '.join(f'cast(cast({c} as float) as double) as {c}' for c in _WIDE)} from ({sql})"


def _block(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _, _ = _rasters(spark, wide(tuned(spark), sf_dir, "px_part"))
    pixels = read_months(spark, files, raw=True, tileSize=16).where("x >= 5 and x < 45 and y >= 3")
    return arrays_to_wide(pixels).where(F.coalesce(*months("pr")).isNotNull())


_add("raster_read_block", _block, f"{_as_stored(wide_sql('px_part'))} where pixel_id % {GRID} between 5 and 44 and pixel_id >= {3 * GRID}")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored integers with missing marks in files, decoded by the source."""
    raw = _raw(tuned(spark), sf_dir)
    cells = [F.max(F.when(F.col("month") == m, F.col("raw"))).alias(column(s, m)) for s in SERIES for m in MONTHS]
    files, _, _ = _rasters(spark, raw.groupBy("pixel_id").agg(*cells))
    pixels = wide_to_long(arrays_to_wide(read_months(spark, files), kind="float"))
    return pixels.select("pixel_id", "month", F.col("tas").cast("double").alias("tas"), F.col("pr").cast("double").alias("pr")).where("pr is not null")


def _value(by: D.Scale) -> str:
    return f"cast(cast(raw as float) * cast({by.scale} as float) + cast({by.offset} as float) as double)"


_add("raster_decode", _marked, f"select pixel_id, month, {_value(D.TEMPERATURE)} as tas, {_value(D.PRECIPITATION)} as pr from ({_RAW_SQL}) where raw <> -9999")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 files in, 19 files out, read back as one row a cell that holds anything."""
    files, grid, out = _rasters(spark, wide(tuned(spark), sf_dir, "px_part"))
    write_bio(bioclim(arrays_to_wide(read_months(spark, files, raw=True))), out, grid)
    cells = read_rasters(spark, {n: f"{out}/{n}.tif" for n in NAMES})
    found = cells.groupBy("pixel_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).cast("double").alias(n) for n in NAMES])
    return found.where(F.coalesce(*[F.col(n) for n in NAMES]).isNotNull())


_add(
    "raster_round_trip",
    _round_trip,
    f"select pixel_id, {', '.join(f'cast(cast({n} as float) as double) as {n}' for n in NAMES)} from ({O.select(O.indicators(), _as_stored(wide_sql('px_part')))}) "
    f"where coalesce({', '.join(NAMES)}) is not null",
)


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indicator from rasters, by URI: only the twelve files of its series are opened, which are all that there are."""
    px = wide(tuned(spark), sf_dir, "px_part")
    files, _, out = _rasters(spark, px.select("pixel_id", *[column("pr", m) for m in MONTHS]), ("pr",))
    uris = {"pr": [p if "://" in p else f"file://{p}" for p in files["pr"]]}
    return bioclim(arrays_to_wide(read_months(spark, uris, ("pr",), raw=True), series=("pr",)), ("bio12",)).where("bio12 is not null")


_add("raster_one_series", _pruned, f"select * from ({O.select({'bio12': O.indicators()['bio12']}, _as_stored(wide_sql('px_part')))}) where bio12 is not null")


def _grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the grid lies, as read from the files' headers."""
    files, _, _ = _rasters(spark, wide(tuned(spark), sf_dir, "px_part").select("pixel_id", *[column("pr", m) for m in MONTHS]), ("pr",))
    return read_grid(spark, files, ("pr",))


_WKT = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
_add(
    "raster_grid",
    _grid_of,
    f"select {GRID} as width, cast(max(l_partkey) // {GRID} + 1 as int) as height, '{_WKT}' as wkt, cast(-20 as double) as x0, cast(0.5 as double) as dx_col, cast(0 as double) as dx_row, "
    "cast(40 as double) as y0, cast(0 as double) as dy_col, cast(-0.5 as double) as dy_row from lineitem",
)
