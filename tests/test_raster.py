import numpy as np
import pytest
from pluvia.cli import main
from pluvia.functions.months import SERIES, arrays_to_wide
from pluvia.operators.indicators import bioclim
from pluvia.sources import tiff
from pluvia.sources.raster import expand, inspect, read_block, read_months

W, H = 10, 10
GEO = ((36.0, 18.0, 0.0), (0.0, 0.0, 0.0, -180.0, 90.0, 0.0), tiff.EPSG_4326)
SHIFT = {"tas": 0, "tasmax": 1, "tasmin": -1, "pr": 0}


@pytest.fixture(scope="module")
def rasters(tmp_path_factory):
    """48 uniform files; one cell of each holds the missing mark."""
    d = tmp_path_factory.mktemp("rasters")
    for s in SERIES:
        for m in range(1, 13):
            image = np.full((H, W), m + SHIFT[s], "f4")
            image[3, 4] = -9999
            tiff.write_cog(f"{d}/{s}_{m:02d}.tif", lambda y, h, im=image: im[y : y + h], W, H, GEO)
    return {s: f"{d}/{s}_*.tif" for s in SERIES}


@pytest.mark.parametrize("size", [0, 1, 255, 5000, 40_000])
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, np.uint8).tobytes(), rng.integers(0, 3, size, np.uint8).tobytes(), b"a" * size):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_image_round_trip_with_overviews(tmp_path):
    image = np.random.default_rng(1).normal(size=(700, 1100)).astype("f4")
    path = str(tmp_path / "x.tif")
    tiff.write_cog(path, lambda y, h: image[y : y + h], 1100, 700, GEO)
    with open(path, "rb") as f:
        images = tiff.directories(f)
        assert [(i.width, i.height) for i in images] == [(1100, 700), (550, 350), (275, 175)]
        assert np.array_equal(tiff.read_window(f, images[0], 0, 0, 1100, 700), image)
        assert np.array_equal(tiff.read_window(f, images[0], 500, 505, 30, 20), image[505:525, 500:530])
        assert np.array_equal(tiff.read_window(f, images[1], 0, 0, 550, 350), image[::2, ::2])
        with pytest.raises(ValueError, match="outside"):
            tiff.read_window(f, images[0], 1090, 0, 20, 1)
    assert images[0].geotransform == (-180.0, 36.0, 0.0, 90.0, 0.0, -18.0)
    assert np.isnan(images[0].nodata) and not tiff.cog_faults(path)


def test_reader(spark, rasters):
    grid = inspect({s: expand(p) for s, p in rasters.items()}, strict=True)
    assert (grid.width, grid.height) == (W, H)
    df = read_months(spark, rasters, raw=True, tileSize=3)
    assert df.rdd.getNumPartitions() == 4
    rows = {r.pixel_id: r for r in df.collect()}
    assert len(rows) == 100 and rows[34].tas == [None] * 12 and rows[0].pr == [float(m) for m in range(1, 13)]
    part = df.where("y >= 2 and y < 5 and x = 4").collect()
    assert sorted(r.pixel_id for r in part) == [24, 34, 44]
    decoded = read_months(spark, rasters).where("pixel_id = 0").first()
    assert decoded.tas[0] == pytest.approx(0.1 - 273.15, abs=1e-4) and decoded.pr[11] == pytest.approx(1.2)


def test_decode_order(rasters):
    path = expand(rasters["tas"])[0]
    block = read_block(path, 3, 3, 3, 1)
    assert np.isnan(block[1]) and block[0] == 1


def test_reader_errors(rasters):
    files = {s: expand(p) for s, p in rasters.items()}
    with pytest.raises(ValueError, match="12 files"):
        inspect({**files, "pr": files["pr"][:11]})
    with pytest.raises(ValueError, match="missing.tif"):
        inspect({**files, "pr": [*files["pr"][:11], "/missing.tif"]})


def test_command_line(spark, rasters, tmp_path):
    args = [x for s in SERIES for x in (f"--{s}", rasters[s])]
    assert main([*args, "--outdir", str(tmp_path), "--tile-size", "4", "--raw"]) == 0
    want = bioclim(arrays_to_wide(read_months(spark, rasters, raw=True), kind="float"), precision="float").where("pixel_id = 0").first()
    for i in (1, 4, 12, 19):
        path = str(tmp_path / f"bio{i:02d}.tif")
        assert not tiff.cog_faults(path)
        with open(path, "rb") as f:
            image = tiff.directories(f)[0]
            got = tiff.read_window(f, image, 0, 0, W, H)
        assert got[0, 0] == pytest.approx(want[f"bio{i:02d}"]) and np.isnan(got[3, 4]) and image.geo == GEO
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".parts")]
    assert main(["--nonsense"]) == 1 and main(["--version"]) == 0
    assert main([*args, "--tile-size", "0"]) == 1 and main([*args, "--tas", "/missing.tif"]) == 1
