import struct
import zlib

import numpy as np
import pytest
from pluvia.functions.months import SERIES
from pluvia.rasters import compute_bioclim
from pluvia.sources import crs, tiff
from pluvia.sources.files import Ranged, expand, merged
from pluvia.sources.raster import Grid, MonthReader, Raster, columns, inspect, read_grid, read_months, read_rasters, write_rasters
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

GEO = ((0.5, 0.5, 0.0), (0.0, 0.0, 0.0, -20.0, 40.0, 0.0), tiff.EPSG_4326)


def by_hand(path, image, how=tiff.NONE, predictor=1, pack=lambda x: x, rows=4):
    """A plain TIFF of strips, written here from the format's description."""
    h, w = image.shape
    strips = [pack(image[y : y + rows]) for y in range(0, h, rows)]
    starts, at = [], 8
    for s in strips:
        starts.append(at)
        at += len(s)
    at += at % 2
    kind = {"f": 3, "i": 2, "u": 1}[image.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * image.dtype.itemsize]), (259, 3, [how]), (262, 3, [1]), (273, 4, starts), (277, 3, [1]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (339, 3, [kind])]
    extra_at, body, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, k, v in tags:
        raw = struct.pack(f"<{len(v)}{'H' if k == 3 else 'I'}", *v)
        if len(raw) > 4:
            raw, extra = struct.pack("<I", extra_at + len(extra)), extra + raw
        body += struct.pack("<HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
    data = b"".join(strips)
    with open(path, "wb") as f:
        f.write((struct.pack("<2sHI", b"II", 42, at) + data).ljust(at, b"\0") + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + extra)


def planes(part):
    """The floating-point predictor, byte by byte."""
    out = bytearray()
    for row in part.astype(">f4"):
        raw = row.tobytes()
        line = [raw[4 * i + b] for b in range(4) for i in range(len(row))]
        out += bytes([line[0]] + [(b - a) % 256 for a, b in zip(line, line[1:], strict=False)])
    return bytes(out)


def packbits(part):
    raw, out, at = part.tobytes(), bytearray(), 0
    while at < len(raw):
        n = 1
        while at + n < len(raw) and n < 128 and raw[at + n] == raw[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, raw[at]])
        else:
            out += bytes([0, raw[at]])
        at += n
    return bytes(out) + b"\x80"


def zstd(part):
    import zstandard

    return zstandard.ZstdCompressor().compress(part.tobytes())


@pytest.mark.parametrize("how, predictor, pack", [(tiff.NONE, 3, planes), (tiff.DEFLATE, 3, lambda p: zlib.compress(planes(p))), (tiff.LZW, 3, lambda p: tiff.lzw_encode(planes(p))), (tiff.PACKBITS, 1, packbits), (tiff.ZSTD, 1, zstd), (tiff.NONE, 1, lambda p: p.tobytes())])
def test_codecs(tmp_path, how, predictor, pack):
    image = np.round(np.random.default_rng(1).normal(size=(11, 13)), 1).astype("<f4")
    image[3:5] = 7
    path = f"{tmp_path}/x.tif"
    by_hand(path, image, how, predictor, pack)
    for uri in (path, f"file://{path}", f"file:{path}"):
        with Raster(uri) as r:
            assert np.array_equal(tiff.read_window(r.file, r.image, 0, 0, 13, 11), image)
            assert np.array_equal(tiff.read_window(r.file, r.image, 5, 3, 4, 7), image[3:10, 5:9])
    if predictor == 3:
        assert tiff.planes_split(image) == planes(image)


def test_ranges(tmp_path):
    image = np.random.default_rng(2).normal(size=(1024, 2048)).astype("<f4")
    path = f"{tmp_path}/x.tif"
    tiff.write_cog(path, lambda y, h: image[y : y + h], 2048, 1024, GEO)
    with Raster(f"file://{path}") as r:
        opened = r.file.requests
        assert opened <= 2  # all directories and the tiles' places
        assert np.array_equal(tiff.read_window(r.file, r.image, 0, 0, 2048, 512), image[:512]) and r.file.requests == opened + 1  # four tiles side by side
        assert np.array_equal(tiff.read_window(r.file, r.image, 600, 600, 10, 10), image[600:610, 600:610]) and r.file.requests == opened + 2
    assert [(a, b, held) for a, b, held in merged([(100, 10), (0, 50), (9000, 5), (111, 9)], gap=60)] == [(0, 120, [1, 0, 3]), (9000, 9005, [2])]
    with Ranged(path, 16) as f:
        f.seek(f.size - 3)
        assert len(f.read(10)) == 3 and f.read(5) == b""
    assert expand(f"file://{tmp_path}/*.tif") == [f"file://{path}"] and expand(f"{tmp_path}/*.tif") == [path] and expand(f"file://{tmp_path}/none/*.tif") == []


@pytest.fixture(scope="module")
def monthly(tmp_path_factory):
    d = tmp_path_factory.mktemp("monthly")
    for s in SERIES:
        for m in range(1, 13):
            image = np.full((40, 50), m, "f4")
            image[3, 4] = -5 if s == "pr" else np.nan
            tiff.write_cog(f"{d}/{s}_{m:02d}.tif", lambda y, h, im=image: im[y : y + h], 50, 40, GEO, tile=16, nodata=-5.0)
    return {s: f"{d}/{s}_*.tif" for s in SERIES}


def test_one_call(spark, monthly, tmp_path):
    out = compute_bioclim(spark, pr=monthly["pr"], outputs=["bio12", "bio13"], outdir=f"file://{tmp_path}/out", raw=True, nodata="file", tileSize=16)
    rows = {r.pixel_id: r for r in out.collect()}
    assert len(rows) == 2000 and rows[0].bio12 == 78 and rows[154].bio12 is None and rows[9].bio13 == 12
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["bio12.tif", "bio13.tif"]
    assert {r.name: (r.n, r.v) for r in read_rasters(spark, {"b": f"file://{tmp_path}/out/bio12.tif"}).groupBy("name").agg(F.count("value").alias("n"), F.max("value").alias("v")).collect()} == {"b": (1999, 78.0)}
    for wrong, what in (({"pr": monthly["pr"], "colour": 1}, "option"), ({"pr": "/none/*.tif"}, "no file"), ({"pr": expand(monthly["pr"])[:11]}, "12 files"), ({}, "needed"), ({"pr": monthly["pr"], "tileSize": 0}, "tileSize")):
        with pytest.raises(ValueError, match=what):
            compute_bioclim(spark, outputs=["bio12"], **wrong)
    with pytest.raises(ValueError, match="needed"):
        compute_bioclim(spark, pr=monthly["pr"], outputs=["bio08"])


def test_only_wanted_series_are_opened(monthly, monkeypatch):
    opened = []
    plain = Raster.__init__
    monkeypatch.setattr(Raster, "__init__", lambda self, path: (opened.append(path), plain(self, path))[1])
    reader = MonthReader({"pr": monthly["pr"], "tas": "/none.tif", "raw": "true"}, _parse_datatype_string(columns(["pr"])))
    assert len(set(opened)) == 12 and all("/pr_" in p for p in opened)
    opened.clear()
    (batch, *_) = reader.read(reader.partitions()[0])
    assert batch.schema.names == ["pixel_id", "x", "y", "pr"] and len(opened) == 12


def test_rectangles(monthly):
    reader = MonthReader({"pr": monthly["pr"], "tilesize": "16", "tilewidth": "20"}, _parse_datatype_string(columns(["pr"])))
    parts = reader.partitions()
    assert [(p.x, p.width) for p in parts[:2]] == [(0, 32), (32, 18)] and len(parts) == 6
    assert sum(p.width * p.height for p in parts) == 2000
    reader.box = [33, 40, 17, 20]
    assert [(p.x, p.y, p.width, p.height) for p in reader.partitions()] == [(33, 17, 7, 3)]
    reader.grid = Grid(43_200, 21_600, GEO, None, (512, 512))
    reader.rows, reader.wide, reader.box = 512, 0, [0, 43_200, 0, 21_600]
    parts = reader.partitions()
    assert len(parts) == 43 * 11 and max(p.width * p.height for p in parts) <= 1 << 21 and all(p.x % 512 == 0 for p in parts)
    reader.box = [1000, 1100, 5000, 5001]
    assert len(reader.partitions()) == 1
    reader.box = [5, 5, 0, 10]
    assert [(p.width, p.height) for p in reader.partitions()] == [(0, 0)] and list(reader.read(reader.partitions()[0])) == []


def test_large_sparse_grid_is_written_by_tasks(spark, tmp_path):
    side = 8192
    df = spark.range(3000).selectExpr("id * 22369 as pixel_id", "cast(id as float) as a", "cast(if(id < 10, id, null) as float) as b", "cast(null as float) as c")
    write_rasters(df, str(tmp_path), Grid(side, side, GEO, None), {"a": "a", "b": "b", "c": "c"})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif", "c.tif"]
    found = {}
    for name in "abc":
        assert not tiff.cog_faults(f"{tmp_path}/{name}.tif", full=True)
        with Raster(f"{tmp_path}/{name}.tif") as r:
            assert [i.width for i in r.images] == [8192, 4096, 2048, 1024, 512] and r.image.geo[:3] == GEO
            found[name] = [float(tiff.read_window(r.file, r.image, p % side, p // side, 1, 1)[0, 0]) for p in (0, 5 * 22369, 2999 * 22369, 7)]
    assert found["a"][:3] == [0, 5, 2999] and np.isnan(found["a"][3]) and found["b"][1] == 5 and np.isnan(found["b"][2]) and np.isnan(found["c"]).all()
    with pytest.raises(Exception, match="wrong"):
        write_rasters(df.withColumn("a", F.expr("cast(raise_error('wrong') as float)")), str(tmp_path), Grid(side, side, GEO, None), {"a": "a"})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif", "c.tif"]


def test_structure_is_checked_tile_by_tile(tmp_path):
    image = np.random.default_rng(3).normal(size=(1200, 1100)).astype("f4")
    path = f"{tmp_path}/x.tif"
    tiff.write_cog(path, lambda y, h: image[y : y + h], 1100, 1200, GEO)
    good = open(path, "rb").read()
    assert not tiff.cog_faults(path, full=True)
    with open(path, "rb") as f:
        images = tiff.directories(f)
    offset, count = images[0].tags[tiff.TILE_OFFSETS][2], images[0].tags[tiff.TILE_COUNTS][2]

    def faults(at, new):
        with open(path, "wb") as f:
            f.write(good[:at] + new + good[at + len(new) :])
        return tiff.cog_faults(path, full=True)

    assert faults(offset - 4, struct.pack("<I", count + 1)) == ["tile 2 of directory 0 has another size before it"]
    assert faults(offset + count, bytes(x ^ 1 for x in good[offset + count : offset + count + 4])) == ["the last bytes of tile 2 of directory 0 aren't repeated"]
    places = struct.pack("<I", offset)
    at = good.index(struct.pack("<I", images[0].tags[tiff.TILE_OFFSETS][1]) + places)
    assert "the tiles of directory 0 aren't in row order" in faults(at, places + good[at : at + 4])
    assert faults(8, b"X") == ["no structural metadata"]
    wide = good.index(struct.pack("<HHI", 256, 4, 1) + struct.pack("<I", 550))
    assert any("half as large" in x for x in faults(wide + 8, struct.pack("<I", 551)))


def test_well_known_text(spark, monthly, tmp_path):
    row = read_grid(spark, monthly, ("pr",)).first()
    assert (row.width, row.height, row.x0, row.dx_col, row.y0, row.dy_row) == (50, 40, -20.0, 0.5, 40.0, -0.5)
    assert row.wkt.startswith('GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563') and row.wkt.endswith('AUTHORITY["EPSG","4326"]]')
    own = (1, 1, 0, 12, 1024, 0, 1, 1, 2048, 0, 1, 32767, 2049, 34737, 7, 0, 2057, 34736, 1, 0, 2059, 34736, 1, 1, 3072, 0, 1, 32767, 3073, 34737, 8, 7, 3075, 0, 1, 11, 3076, 0, 1, 9001, 3078, 34736, 1, 2, 3079, 34736, 1, 3, 3084, 34736, 1, 4)
    geo = (*GEO[:2], own, None, (6371000.0, 0.0, 29.5, 45.5, -96.0), ("Sphere|Equal A|",))
    path = f"{tmp_path}/own.tif"
    tiff.write_cog(path, lambda y, h: np.zeros((h, 20), "f4"), 20, 20, geo)
    with Raster(path) as r:
        grid = Grid(20, 20, r.image.geo, r.image.geotransform)
    assert grid.wkt == (
        'PROJCS["Equal A",GEOGCS["Sphere",DATUM["unknown",SPHEROID["unknown",6371000,0]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Albers_Conic_Equal_Area"],'
        'PARAMETER["standard_parallel_1",29.5],PARAMETER["standard_parallel_2",45.5],PARAMETER["latitude_of_center",0],PARAMETER["longitude_of_center",-96],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1]]'
    )
    utm = crs.wkt({1024: 1, 3072: 32733})
    assert 'UTM zone 33S' in utm and 'PARAMETER["central_meridian",15]' in utm and 'PARAMETER["false_northing",10000000]' in utm
    assert crs.wkt({}) is None and crs.wkt({1024: 2, 2048: 4322}).startswith('GEOGCS["WGS 72"') and crs.wkt({1024: 1, 3072: 2056}) == 'PROJCS["unknown",AUTHORITY["EPSG","2056"]]'


def test_strict_inspection_names_the_file(monthly, tmp_path):
    path = f"{tmp_path}/x.tif"
    tiff.write_cog(path, lambda y, h: np.zeros((h, 50), "f4"), 50, 40, GEO, nodata=-1.0)
    files = {s: expand(p) for s, p in monthly.items()}
    files["pr"][3] = path
    assert inspect(files).width == 50
    with pytest.raises(ValueError, match="x.tif differs"):
        inspect(files, strict=True)


def test_nothing_to_read(spark, monthly):
    assert read_months(spark, monthly, ("pr",)).where("x > 49").count() == 0 and read_months(spark, monthly, ()).count() == 2000
