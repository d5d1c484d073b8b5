import io
import json
import struct

import numpy as np
from pluvia.sources import tiff
from pluvia.sources.raster import expand, inspect, read_months, write_rasters
from pluvia.tools import report, sample, validate


def test_sample_is_read_and_validated(spark, tmp_path, capsys):
    files = sample.write(str(tmp_path))
    assert sum(map(len, files.values())) == 48
    df = read_months(spark, {s: f"{tmp_path}/{s}_*.tif" for s in files}, raw=True)
    assert df.count() == 100 and df.first().tasmax == [float(m + 1) for m in range(1, 13)]
    assert validate.main([str(tmp_path)]) == 0 and capsys.readouterr().out.count(" ok\n") == 48
    assert validate.main([str(tmp_path), "--pattern", "*.none"]) == 1
    (tmp_path / "zz.tif").write_bytes(b"not a raster")
    assert validate.main([str(tmp_path)]) == 1 and "can't be read" in capsys.readouterr().out


def test_report(monkeypatch, capsys):
    line = json.dumps({"metric": "m", "value": 1.5, "unit": "sec", "queries": {"q": 1.5}, "sf": "here"})
    monkeypatch.setattr("sys.stdin", io.StringIO(f"noise\n{line}\n"))
    assert report.main() == 0
    out = capsys.readouterr().out
    assert "| q | 1.5 |" in out and "| cores |" in out
    monkeypatch.setattr("sys.stdin", io.StringIO("noise\n"))
    assert report.main() == 1


def strips(path, image, bands, planar=1, predictor=1):
    """A big-endian file of uncompressed strips of three rows."""
    h, w = image.shape
    stack = np.stack([image] + [image * 0 - 5] * (bands - 1), axis=2 if planar == 1 else 0).astype(">i2")
    if predictor == 2:
        stack = np.concatenate([stack[:, :1], np.diff(stack, axis=1)], axis=1).astype(">i2")
    planes = [stack] if planar == 1 else list(stack)
    data = [p[y : y + 3].tobytes() for p in planes for y in range(0, h, 3)]
    at, offsets = 8, []
    for d in data:
        offsets.append(at)
        at += len(d)
    tags = [(256, 3, (w,)), (257, 3, (h,)), (258, 3, (16,)), (259, 3, (1,)), (273, 4, tuple(offsets)), (277, 3, (bands,)), (278, 3, (3,)), (279, 4, tuple(map(len, data))), (284, 3, (planar,)), (317, 3, (predictor,)), (339, 3, (2,)), (34264, 12, (2.0, 0.5, 0, 10.0, 0.25, -3.0, 0, 20.0, 0, 0, 0, 0, 0, 0, 0, 1)), (34736, 12, (6378137.0,)), (34737, 2, b"own|\0")]
    body, extra = b"", b""
    tail = at + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        raw = v if kind == 2 else struct.pack(f">{len(v)}{tiff.CODES[kind]}", *v)
        if len(raw) > 4:
            place, extra = tail + len(extra), extra + raw
            raw = struct.pack(">I", place)
        body += struct.pack(">HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    with open(path, "wb") as f:
        f.write(b"MM" + struct.pack(">HI", 42, at) + b"".join(data) + struct.pack(">H", len(tags)) + body + bytes(4) + extra)


def test_first_band_of_strips_and_place_tags(tmp_path):
    image = np.arange(70).reshape(10, 7) - 9
    for bands, planar, predictor in ((1, 1, 1), (3, 1, 1), (3, 2, 1), (2, 1, 2)):
        path = f"{tmp_path}/x.tif"
        strips(path, image, bands, planar, predictor)
        with open(path, "rb") as f:
            found = tiff.directories(f)[0]
            assert np.array_equal(tiff.read_window(f, found, 0, 0, 7, 10), image)
            assert np.array_equal(tiff.read_window(f, found, 2, 4, 3, 5), image[4:9, 2:5])
        assert found.geotransform == (10.0, 2.0, 0.5, 20.0, 0.25, -3.0) and found.geo[4:] == ((6378137.0,), ("own|",))
        assert found.block == (3, 7)


def test_place_tags_pass_through_the_sink(spark, tmp_path):
    files = {}
    for s in ("tas", "tasmax", "tasmin", "pr"):
        for m in range(12):
            files.setdefault(s, []).append(f"{tmp_path}/{s}{m:02d}.tif")
            strips(files[s][-1], np.full((10, 7), m), 2)
    grid = inspect(files)
    df = read_months(spark, files, raw=True, tileSize=4)
    assert df.count() == 70 and df.where("x = 3 and y = 9").first().pr == [float(m) for m in range(12)]
    write_rasters(df.selectExpr("pixel_id", "cast(pixel_id as float) as v"), str(tmp_path), grid, {"v": "out"})
    with open(f"{tmp_path}/out.tif", "rb") as f:
        image = tiff.directories(f)[0]
        assert image.geo == grid.geo and np.array_equal(tiff.read_window(f, image, 0, 0, 7, 10).ravel(), np.arange(70))


def test_large_sparse_grid_in_tiles_with_overviews(spark, tmp_path):
    from pluvia.sources.raster import Grid

    grid = Grid(1300, 1100, (None, None, None), None)
    df = spark.range(0, 1300 * 1100).where("id % 1300 < 500 or id % 2 = 0").where("id div 1300 < 600").selectExpr("id as pixel_id", "cast(id % 977 as float) as a")
    write_rasters(df, str(tmp_path), grid, {"a": "big"})
    assert expand(f"{tmp_path}/*.tif") == [f"{tmp_path}/big.tif"] and not list(tmp_path.glob(".parts-*"))
    ids = np.arange(1300 * 1100)
    want = np.where(((ids % 1300 < 500) | (ids % 2 == 0)) & (ids // 1300 < 600), ids % 977, np.nan).astype("f4").reshape(1100, 1300)
    with open(f"{tmp_path}/big.tif", "rb") as f:
        images = tiff.directories(f)
        assert [(i.width, i.height) for i in images] == [(1300, 1100), (650, 550), (325, 275)]
        for k, i in enumerate(images):
            assert np.array_equal(tiff.read_window(f, i, 0, 0, i.width, i.height), want[:: 2**k, :: 2**k], equal_nan=True)
    assert not tiff.cog_faults(f"{tmp_path}/big.tif")
