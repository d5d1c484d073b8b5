"""The raster data source (monthly files as one table of pixels) and sink (one file per indicator)."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.decode import DEFAULTS, NODATA, RAW, Scale
from ..functions.months import SERIES
from ..operators.indicators import NAMES
from . import crs, tiff
from .files import Ranged, expand, is_uri, located

#: Cells of one raster that a task holds at once where it is stored in strips, pixels in a batch, and cells of one raster in a partition.
CELLS, BATCH, PART = 1 << 18, 1 << 15, 1 << 21
#: The option that takes each file's own missing mark.
OWN = "file"


class Raster:
    """An open file; its directories are fetched once, and then only the tiles that are asked for."""

    def __init__(self, path: str):
        try:
            self.file = Ranged(path)
            self.images = tiff.directories(self.file)
        except (OSError, ValueError, struct.error) as e:
            raise ValueError(f"can't open raster {path}: {e}") from e
        self.path, self.image = path, self.images[0]
        self.file.ahead = 0  # from here on lengths are known

    def __enter__(self) -> Raster:
        return self

    def __exit__(self, *_) -> None:
        self.file.__exit__()

    def block(self, x: int, y: int, w: int, h: int, by: Scale = RAW, nodata: float | str | None = NODATA) -> np.ndarray:
        """A rectangle as single precision, row by row, missing cells as NaN; the mark is compared before scaling."""
        raw = tiff.read_window(self.file, self.image, x, y, w, h).astype(np.float32).ravel()
        out = raw * np.float32(by.scale) + np.float32(by.offset)
        mark = self.image.nodata if nodata == OWN else nodata
        if mark is not None:
            out[raw == np.float32(mark)] = np.nan
        return out


def read_block(path: str, x: int, y: int, w: int, h: int, by: Scale = RAW, nodata: float | str | None = NODATA) -> np.ndarray:
    """``Raster.block`` of one file."""
    with Raster(path) as r:
        return r.block(x, y, w, h, by, nodata)


@dataclass(frozen=True)
class Grid:
    width: int
    height: int
    geo: tuple
    geotransform: tuple[float, ...] | None
    #: Rows and columns that the first file stores together.
    block: tuple[int, int] = (512, 512)

    @property
    def wkt(self) -> str | None:
        """The coordinate system in well-known text."""
        tags = {t: v for (t, _), v in zip(tiff.GEO_TAGS, self.geo, strict=False)}
        return crs.wkt(crs.keys(tags.get(tiff.GEO_KEYS), tags.get(tiff.GEO_DOUBLES), tags.get(tiff.GEO_ASCII)))


def inspect(files: dict[str, list[str]], strict: bool = False, series: Sequence[str] = SERIES) -> Grid:
    """Check that there are 12 files of each series with one size; the first file says where the grid lies."""
    first, out = None, None
    for s in series:
        if len(files.get(s, ())) != 12:
            raise ValueError(f"{s} needs exactly 12 files, has {len(files.get(s, ()))}")
        for path in files[s]:
            with Raster(path) as r:
                image = r.image
            if first is None:
                first, out = image, Grid(image.width, image.height, image.geo, image.geotransform, image.block)
            if (image.width, image.height) != (first.width, first.height):
                raise ValueError(f"{path} is {image.width}x{image.height}, the first file {first.width}x{first.height}")
            if strict and (image.geo != first.geo or str(image.nodata) != str(first.nodata) or image.one(tiff.SAMPLES, 1) != 1):
                raise ValueError(f"{path} differs from the first file in its place, its missing mark or its bands")
    return out


def read_grid(spark: SparkSession, files: dict[str, Sequence[str] | str], series: Sequence[str] = SERIES) -> DataFrame:
    """One row: width, height, wkt and the six numbers of the affine transform (x0, dx_col, dx_row, y0, dy_col, dy_row), null where the files don't say."""
    grid = inspect({s: expand(files[s]) for s in series}, series=series)
    places = grid.geotransform or (None,) * 6
    return spark.createDataFrame([(grid.width, grid.height, grid.wkt, *places)], "width int, height int, wkt string, x0 double, dx_col double, dx_row double, y0 double, dy_col double, dy_row double")


@dataclass
class Rectangle(InputPartition):
    x: int
    y: int
    width: int
    height: int


class MonthReader(DataSourceReader):
    """Each partition is a rectangle of all files that are read, so no shuffle brings a pixel's months together.

    Only the series in the user's schema are opened.
    """

    def __init__(self, options: dict, schema: StructType):
        self.columns = schema.names
        self.series = [s for s in SERIES if s in self.columns]
        self.files = {s: expand(json.loads(options[s]) if options.get(s, "").startswith("[") else options.get(s, "").split(",")) for s in self.series or SERIES[:1]}
        self.grid = inspect(self.files, options.get("strictmetadata", "false").lower() == "true", list(self.files))
        self.rows, self.wide = int(options.get("tilesize", 512)), int(options.get("tilewidth", 0))
        if self.rows <= 0 or self.wide < 0:
            raise ValueError("tileSize and tileWidth must be positive")
        raw = options.get("raw", "false").lower() == "true"
        self.scales = {s: RAW if raw else Scale(float(options.get(f"{s}scale", DEFAULTS[s].scale)), float(options.get(f"{s}offset", DEFAULTS[s].offset))) for s in SERIES}
        mark = options.get("nodata", NODATA)
        self.nodata = OWN if mark == OWN else float(mark)
        self.box = [0, self.grid.width, 0, self.grid.height]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on x and y become the window that is read."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at not in (("x",), ("y",)) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            i = 0 if at == ("x",) else 2
            v = int(f.value)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.box[i] = max(self.box[i], v + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.box[i + 1] = min(self.box[i + 1], v + (not isinstance(f, LessThan)))

    def partitions(self) -> list[InputPartition]:
        """Rectangles that begin at multiples of the tile size, as tiles do, and of whole tiles of the first file across: of PART cells, or ``tileWidth`` columns. Only those that the window touches."""
        left, right, lo, hi = self.box
        if left >= right or lo >= hi:
            return [Rectangle(0, 0, 0, 0)]
        block = self.grid.block[1]
        wide = self.wide or max(1, PART // self.rows)
        wide = -(-wide // block) * block if block < self.grid.width else self.grid.width
        return [
            Rectangle(max(x, left), max(y, lo), min(x + wide, right) - max(x, left), min(y + self.rows, hi) - max(y, lo))
            for y in range(lo - lo % self.rows, hi, self.rows)
            for x in range(left - left % wide, right, wide)
        ]

    def blocks(self, p: Rectangle) -> Iterator[tuple[int, int, int, int]]:
        """The partition in pieces of bounded size (x, y, w, h) along the first file's tiles or strips, so that each of those is unpacked once."""
        high, wide = self.grid.block
        if wide < self.grid.width:
            high = max(high, p.height)
        else:
            high = max(1, CELLS // max(1, wide) // high) * high
        y, end, right = p.y, p.y + p.height, p.x + p.width
        while y < end:
            h = min(end, y - y % high + high) - y
            x = p.x
            while x < right:
                w = min(right, x - x % wide + wide) - x
                yield x, y, w, h
                x += w
            y += h

    def read(self, partition: Rectangle) -> Iterator[pa.RecordBatch]:
        opened = {s: [Raster(path) for path in self.files[s]] for s in self.series} if partition.height else {}
        try:
            for x, y, w, h in self.blocks(partition):
                blocks = {s: np.stack([r.block(x, y, w, h, self.scales[s], self.nodata) for r in rasters], axis=1) for s, rasters in opened.items()}
                ys, xs = np.repeat(np.arange(y, y + h), w), np.tile(np.arange(x, x + w), h)
                for i in range(0, w * h, BATCH):
                    here = slice(i, i + BATCH)
                    cols = {"pixel_id": pa.array(ys[here] * self.grid.width + xs[here], pa.int64()), "x": pa.array(xs[here], pa.int32()), "y": pa.array(ys[here], pa.int32())}
                    for s in self.series:
                        block = blocks[s][here].ravel()
                        values = pa.array(block, pa.float32(), mask=np.isnan(block))
                        cols[s] = pa.ListArray.from_arrays(pa.array(np.arange(0, len(block) + 1, 12), pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([cols[c] for c in self.columns], self.columns)
        finally:
            for rasters in opened.values():
                for r in rasters:
                    r.__exit__()


class BioclimRaster(DataSource):
    """``spark.read.format("bioclim_raster")`` with options tas, tasmax, tasmin, pr (JSON lists or commas; globs and URIs allowed), tileSize, tileWidth, raw, nodata (a number, or ``file`` for each file's own mark), strictMetadata and <series>Scale / <series>Offset.

    A schema of some of the columns leaves the files of other series closed.
    """

    @classmethod
    def name(cls) -> str:
        return "bioclim_raster"

    def schema(self) -> str:
        return columns()

    def reader(self, schema: StructType) -> DataSourceReader:
        return MonthReader({k.lower(): v for k, v in dict(self.options).items()}, schema)


def columns(series: Iterable[str] = SERIES) -> str:
    return ", ".join(["pixel_id long", "x int", "y int", *[f"{s} array<float>" for s in series]])


def read_months(spark: SparkSession, files: dict[str, Sequence[str] | str], series: Sequence[str] = SERIES, **options) -> DataFrame:
    """Pixels with an array of twelve months for each of ``series``; only their files are opened. Files are local paths that all executors mount, or URIs."""
    spark.dataSource.register(BioclimRaster)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("bioclim_raster").schema(columns(series))
    for s in series or SERIES[:1]:
        reader = reader.option(s, json.dumps(expand(files[s])))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def read_rasters(spark: SparkSession, files: dict[str, str], rows: int = 512) -> DataFrame:
    """(name, pixel_id, value float): the cells of single rasters, missing ones as null; a task reads ``rows`` rows of one file at a time."""
    parts = []
    for name, path in files.items():
        with Raster(path) as r:
            parts += [(name, path, y, min(rows, r.image.height - y), r.image.width) for y in range(0, r.image.height, rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, path, y, h, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = read_block(path, 0, y, w, h, nodata=None)
                cells = np.arange(y * w, (y + h) * w)
                for i in range(0, len(block), BATCH):
                    part = block[i : i + BATCH]
                    cols = [pa.array([name] * len(part)), pa.array(cells[i : i + BATCH]), pa.array(part, pa.float32(), mask=np.isnan(part))]
                    yield pa.RecordBatch.from_arrays(cols, ["name", "pixel_id", "value"])

    table = spark.createDataFrame(parts, "name string, path string, y int, h int, w int").repartition(len(parts))
    return table.mapInArrow(run, "name string, pixel_id long, value float")


def _tiles(names: list[str], tile: int, how: int):
    """Pixels sorted by tile to packed tiles; one tile of each raster is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, np.full((len(names), tile * tile), np.nan, "<f4")

        def packed() -> pa.RecordBatch:
            some = [i for i, image in enumerate(cells) if not np.isnan(image).all()]
            data = [tiff.packed_tile(cells[i].reshape(tile, tile), how) for i in some]
            cells[:] = np.nan
            level, row, col = ([k] * len(some) for k in now)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((some, level, row, col, data), (*[pa.int32()] * 4, pa.binary()), strict=True)], ["raster", "level", "row", "col", "data"])

        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in ("level", "row", "col")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [keys.shape[1]]])
            at, values = b.column("cell").to_numpy(), [b.column(n).to_numpy(zero_copy_only=False) for n in names]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                key = tuple(int(k) for k in keys[:, lo])
                if now is not None and key != now:
                    yield packed()
                now = key
                for i, v in enumerate(values):
                    cells[i, at[lo:hi]] = v[lo:hi]
        if now is not None:
            yield packed()

    return run


def _assembled(folder: str, names: list[str], width: int, height: int, geo: tuple, how: int):
    """Rows sorted by raster, its tiles' sizes first, then its tiles as they follow in a file: each raster is written as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        made, f = [], None

        def close() -> None:
            made[-1][2] = f.tell()
            f.close()

        for b in batches:
            for raster, kind, index, data in zip(*(b.column(k).to_pylist() for k in ("raster", "kind", "index", "data")), strict=True):
                if kind == 0:
                    if f is not None:
                        close()
                    sizes = [np.zeros(g, np.int64) for g in tiff.tile_grids(width, height)]
                    for t in index or ():
                        sizes[t["level"]][t["row"], t["col"]] = t["size"]
                    path = f"{root}/{names[raster]}.{TaskContext.get().taskAttemptId()}.part"
                    made.append([raster, path, 0])
                    f = store.open_output_stream(path, compression=None)
                    f.write(tiff.heading(sizes, width, height, geo, how=how))
                else:
                    f.write(tiff.marked(data))
        if f is not None:
            close()
        cols = [list(x) for x in zip(*made, strict=True)] or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.string(), pa.int64()), strict=True)], ["raster", "path", "bytes"])

    return run


def write_rasters(df: DataFrame, outdir: str, grid: Grid, names: dict[str, str], how: int = tiff.DEFLATE) -> None:
    """A cloud-optimized GeoTIFF <name>.tif for each column of ``names`` (column: name), in a folder (a path that all executors mount, or a URI).

    ``df`` has pixel_id (row times width plus column) and the columns; cells without
    a row or a value are missing, of rows that repeat a pixel any counts, and files
    of these names are replaced, once all are whole. A table without rows gives rasters
    that are missing throughout. Two distributed steps:

    1. Pixels are dealt by tile, those of overviews (every second row and column of the
       level below) too; tasks pack the tiles, which go to a Parquet table in the folder.
    2. The sizes of a raster's tiles say where each lies, so its directories can be
       written first. A task owns a raster and writes it from front to back, its tiles
       in a stream in file order; that also suits storage without random writes.

    The driver renames the files and sees no tile. What is left of a failed attempt goes.
    """
    store, root = located(outdir)
    store.create_dir(root, recursive=True)
    uri = outdir if is_uri(outdir) else f"file://{root}"
    temp = f".parts-{uuid.uuid4().hex}"
    tile, levels = tiff.pyramid(grid.width, grid.height)
    x, y = F.col("pixel_id") % grid.width, F.expr(f"pixel_id div {grid.width}")
    rows = df.where(F.col("pixel_id").between(0, grid.width * grid.height - 1)).select(x.cast("int").alias("_x"), y.cast("int").alias("_y"), *[F.col(c).cast("float").alias(n) for c, n in names.items()])
    inside = F.filter(F.array(*map(F.lit, range(len(levels)))), lambda k: (F.col("_x").bitwiseOR(F.col("_y")) % F.pow(F.lit(2), k).cast("int")) == 0)
    rows = rows.withColumn("level", F.explode(inside)).withColumn("_x", F.expr("shiftright(_x, level)")).withColumn("_y", F.expr("shiftright(_y, level)"))
    keys = ["level", "row", "col"]
    rows = rows.select("level", F.expr(f"_y div {tile}").cast("int").alias("row"), F.expr(f"_x div {tile}").cast("int").alias("col"), (F.col("_y") % tile * tile + F.col("_x") % tile).cast("int").alias("cell"), *names.values())
    wanted = list(names.values())
    kind = "raster int, level int, row int, col int, data binary"
    try:
        store.create_dir(f"{root}/{temp}")
        rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tiles(wanted, tile, how), kind).write.parquet(f"{uri}/{temp}/tiles")
        tiles = df.sparkSession.read.schema(kind).parquet(f"{uri}/{temp}/tiles")
        index = tiles.groupBy(F.col("raster").alias("of")).agg(F.collect_list(F.struct("level", "row", "col", F.octet_length("data").cast("long").alias("size"))).alias("index"))
        every = df.sparkSession.range(len(wanted)).select(F.col("id").cast("int").alias("raster"))
        none = F.lit(None)
        heads = every.join(index, F.col("raster") == F.col("of"), "left").select("raster", F.lit(0).alias("kind"), none.cast("int").alias("level"), none.cast("int").alias("row"), none.cast("int").alias("col"), "index", none.cast("binary").alias("data"))
        body = tiles.select("raster", F.lit(1).alias("kind"), "level", "row", "col", none.cast(index.schema["index"].dataType).alias("index"), "data")
        order = ["raster", "kind", F.desc("level"), "row", "col"]
        whole = heads.union(body).repartition(len(wanted), "raster").sortWithinPartitions(*order)
        found = whole.mapInArrow(_assembled(f"{outdir}/{temp}", wanted, grid.width, grid.height, grid.geo, how), "raster int, path string, bytes long").collect()
        for r in found:
            store.move(r.path, f"{root}/{wanted[r.raster]}.tif")
    finally:
        store.delete_dir(f"{root}/{temp}")


def write_bio(df: DataFrame, outdir: str, grid: Grid, prefix: str = "bio", how: int = tiff.DEFLATE) -> None:
    """Cloud-optimized GeoTIFFs <prefix>01.tif to <prefix>19.tif of the indicators that ``df`` has."""
    write_rasters(df, outdir, grid, {name: f"{prefix}{i + 1:02d}" for i, name in enumerate(NAMES) if name in df.columns}, how)
