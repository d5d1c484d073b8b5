"""Reading and writing single-band TIFF and BigTIFF rasters with NumPy."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa

from .files import merged

# Fixed values of the TIFF, GeoTIFF and GDAL tag lists.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
SUBFILE, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 254, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
TRANSFORM, GEO_DOUBLES, GEO_ASCII, PLANAR = 34264, 34736, 34737, 284
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
CLEAR, END = 256, 257


#: After a CLEAR the width of a code depends on its number alone; numbers up to where no table can reach.
_WIDTHS = np.searchsorted([512, 1024, 2048], 258 + np.arange(8192), "right").astype(np.int64) + 9
_STARTS = np.cumsum(_WIDTHS) - _WIDTHS


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first; the code width grows one entry early, as TIFF asks.

    Codes are cut out a table at a time. An entry's string is what was put out from
    the code that made it on, and one byte more; so lengths, and then for each byte
    the earlier byte that it repeats, are found by following pointers in parallel.
    """
    raw, total, bit = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64), 8 * len(data), 0
    parts, bases, n = [], [], 0
    while True:
        at = bit + _STARTS
        at = at[: np.searchsorted(at + _WIDTHS, total, "right")]
        width, byte = _WIDTHS[: len(at)], at >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (at & 7) - width) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        k = stops[0] if len(stops) else len(codes)
        parts.append(codes[:k])
        bases.append(np.full(k, n))
        n += k
        if not len(stops) or codes[k] == END:
            break
        bit = int(at[k] + width[k])
    code, base = np.concatenate(parts), np.concatenate(bases)
    if not n:
        return b""
    old, number = code > END, np.arange(n)
    made_by = np.where(old, code - 258 + base, number)
    if (made_by > number).any() or (made_by[old] >= number[old]).any():
        raise ValueError("not a stream of LZW codes")
    size, to = old.astype(np.int64), made_by
    while size[to].any():
        size, to = size + size[to], to[to]
    size += 1
    start = np.cumsum(size) - size
    source = np.arange(int(size.sum())) + np.repeat(start[made_by] - start, size)
    value = np.zeros(len(source), np.uint8)
    value[start[~old]] = code[~old]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return value[source].tobytes()
        source = further


def lzw_encode(data: bytes) -> bytes:
    codes, counts = [CLEAR], [1]
    table: dict[int, int] = {}
    free, now = 258, -1
    for c in data:
        if now < 0:
            now = c
            continue
        key = now << 8 | c
        known = table.get(key)
        if known is not None:
            now = known
            continue
        codes.append(now)
        table[key] = free
        free += 1
        if free == 4094:
            codes.append(CLEAR)
            counts.append(len(codes) - sum(counts))
            table, free = {}, 258
        now = c
    codes += [now, END] if now >= 0 else [END]
    counts.append(len(codes) - sum(counts))
    width = np.concatenate([_WIDTHS[:k] for k in counts])
    which = np.repeat(np.arange(len(codes), dtype=np.int32), width)
    ends = np.cumsum(width)
    shift = (np.repeat(ends.astype(np.int64), width) - 1 - np.arange(ends[-1])).astype(np.int32)
    return np.packbits((np.array(codes, np.int32)[which] >> shift & 1).astype(np.uint8)).tobytes()


def packbits_decode(data: bytes) -> bytes:
    """Runs: a count below 128 and one byte more than it says as they are, or a count from 129 on and a byte that is repeated."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def planes_split(image: np.ndarray) -> bytes:
    """The floating-point predictor: of each row all first bytes, then all second ones, as differences. ``image`` is rows of cells or of cells of several bands."""
    rows = np.ascontiguousarray(image).astype(image.dtype.newbyteorder(">"))
    bands, wide = (rows.shape[2] if rows.ndim == 3 else 1), rows.dtype.itemsize
    planes = rows.view(np.uint8).reshape(len(rows), -1, wide).transpose(0, 2, 1).reshape(len(rows), -1)
    out = planes.copy()
    out[:, bands:] -= planes[:, :-bands]
    return out.tobytes()


def planes_joined(raw: bytes, shape: tuple[int, int, int], dtype: np.dtype) -> np.ndarray:
    """Rows, columns and bands again."""
    rows, cols, bands = shape
    planes = np.frombuffer(raw, np.uint8, rows * cols * bands * dtype.itemsize).reshape(rows, -1, bands)
    planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * bands)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape).astype(dtype)


#: Tags that say where a grid lies, and their types.
GEO_TAGS = ((PIXEL_SCALE, 12), (TIE_POINT, 12), (GEO_KEYS, 3), (TRANSFORM, 12), (GEO_DOUBLES, 12), (GEO_ASCII, 2))


@dataclass
class Image:
    """One directory of a file: its tags, and where its tiles or strips are."""

    tags: dict[int, tuple] = field(default_factory=dict)
    order: str = "<"
    #: Where the directory lies in its file.
    at: int = 0

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def width(self) -> int:
        return self.one(WIDTH)

    @property
    def height(self) -> int:
        return self.one(HEIGHT)

    @property
    def tiled(self) -> bool:
        return TILE_OFFSETS in self.tags

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.one(FORMAT, 1)]
        return np.dtype(f"{self.order}{kind}{self.one(BITS, 8) // 8}")

    @property
    def nodata(self) -> float | None:
        raw = self.tags.get(NODATA)
        return float(raw[0].strip("\0 ")) if raw else None

    @property
    def geo(self) -> tuple:
        """What says where the grid lies: pixel scale, tie point and keys, and, if any is there, the affine transform and the keys' numbers and texts."""
        all_ = tuple(self.tags.get(t) for t, _ in GEO_TAGS)
        return all_ if any(all_[3:]) else all_[:3]

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns that are stored together."""
        if self.tiled:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(ROWS_PER_STRIP, self.height), self.height), self.width

    @property
    def geotransform(self) -> tuple[float, ...] | None:
        scale, tie, affine = self.tags.get(PIXEL_SCALE), self.tags.get(TIE_POINT), self.tags.get(TRANSFORM)
        if affine:
            return (affine[3], affine[0], affine[1], affine[7], affine[4], affine[5])
        if not scale or not tie:
            return None
        return (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])


def directories(f: BinaryIO) -> list[Image]:
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    out = []
    while at and len(out) < 64:
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size = 20 if big else 12
        raw = f.read(n * size + (8 if big else 4))
        image = Image(order=order, at=at)
        for i in range(n):
            entry = raw[i * size : (i + 1) * size]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 12 if big else 8])[0]
            value, need = entry[12 if big else 8 :], count * SIZES.get(kind, 1)
            if need > len(value):
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(need)
            if kind == 2:
                image.tags[tag] = (value[:need].split(b"\0")[0].decode("latin-1"),)
            elif kind in CODES:
                image.tags[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", value[:need])
        out.append(image)
        at = struct.unpack(order + ("Q" if big else "I"), raw[n * size :])[0]
    return out


def _unpacked(raw: bytes, image: Image, shape: tuple[int, int]) -> np.ndarray:
    how = image.one(COMPRESSION, NONE)
    bands = image.one(SAMPLES, 1) if image.one(PLANAR, 1) == 1 else 1
    if how == LZW:
        raw = lzw_decode(raw)
    elif how in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif how == PACKBITS:
        raw = packbits_decode(raw)
    elif how == ZSTD:
        raw = pa.decompress(raw, shape[0] * shape[1] * bands * image.dtype.itemsize, "zstd", asbytes=True)
    elif how != NONE:
        raise ValueError(f"compression {how} isn't supported")
    predictor = image.one(PREDICTOR, 1)
    if predictor == 3 and image.dtype.kind == "f":
        return planes_joined(raw, (*shape, bands), image.dtype)[:, :, 0]
    out = np.frombuffer(raw, image.dtype, shape[0] * shape[1] * bands).reshape(*shape, bands)
    if predictor == 2:
        with np.errstate(over="ignore"):
            out = np.cumsum(out, axis=1, dtype=out.dtype)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return out[:, :, 0]


def read_window(f: BinaryIO, image: Image, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A rectangle of the first band as stored; only the tiles or strips that it touches are read, neighbours at once. Tiles that a file leaves out hold its missing mark."""
    if x < 0 or y < 0 or w < 0 or h < 0 or x + w > image.width or y + h > image.height:
        raise ValueError("the window is outside the raster")
    mark = image.nodata
    out = np.full((h, w), 0 if mark is None or (mark != mark and image.dtype.kind != "f") else mark, image.dtype)
    if not w or not h:
        return out
    th, tw = image.block
    offsets, counts = (image.tags[t] for t in ((TILE_OFFSETS, TILE_COUNTS) if image.tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    across = -(-image.width // tw)
    cells = [(r, c) for r in range(y // th, (y + h - 1) // th + 1) for c in range(x // tw, (x + w - 1) // tw + 1) if counts[r * across + c]]
    for start, end, held in merged([(offsets[r * across + c], counts[r * across + c]) for r, c in cells]):
        f.seek(start)
        data = f.read(end - start)
        for r, c in (cells[i] for i in held):
            rows = th if image.tiled else min(th, image.height - r * th)
            at = offsets[r * across + c] - start
            tile = _unpacked(data[at : at + counts[r * across + c]], image, (rows, tw))
            y0, y1 = max(y, r * th), min(y + h, r * th + rows)
            x0, x1 = max(x, c * tw), min(x + w, (c + 1) * tw)
            out[y0 - y : y1 - y, x0 - x : x1 - x] = tile[y0 - r * th : y1 - r * th, x0 - c * tw : x1 - c * tw]
    return out


#: WGS 84 longitude and latitude, cells as areas.
EPSG_4326 = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)


def pyramid(width: int, height: int, tile: int = 512) -> tuple[int, list[tuple[int, int]]]:
    """The side of tiles, and the sizes of the image and its overviews, halved while a side is over a tile."""
    tile = min(tile, -(-max(width, height) // 16) * 16)  # tiles come in sixteens
    levels = [(width, height)]
    while max(levels[-1]) > tile:
        levels.append((-(-levels[-1][0] // 2), -(-levels[-1][1] // 2)))
    return tile, levels


#: What stands before the first directory: how tiles lie, which readers may rely on.
STRUCTURE = b"LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\nBLOCK_LEADER=SIZE_AS_UINT4\nBLOCK_TRAILER=LAST_4_BYTES_REPEATED\nKNOWN_INCOMPATIBLE_EDITION=NO\n "
GHOST = b"GDAL_STRUCTURAL_METADATA_SIZE=%06d bytes\n" % len(STRUCTURE) + STRUCTURE
#: Bytes that a tile has besides its own: its size before, its last four again behind.
MARKS = 8


def packed_tile(cells: np.ndarray, how: int = DEFLATE) -> bytes:
    """A square of single-precision cells: split into byte planes and deflated, or by LZW without a predictor."""
    cells = cells.astype("<f4")
    return lzw_encode(cells.tobytes()) if how == LZW else zlib.compress(planes_split(cells), 6)


def marked(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data + data[-4:]


def heading(sizes: list[np.ndarray], width: int, height: int, geo: tuple = (None, None, None), tile: int = 512, nodata: float = float("nan"), how: int = DEFLATE) -> bytes:
    """All bytes before the first tile of a float32 cloud-optimized GeoTIFF, from the sizes of its tiles (a grid for each level; 0: missing throughout).

    Tiles follow in the order of ``in_file``, each with its marks.
    """
    tile, levels = pyramid(width, height, tile)
    text = ("nan" if nodata != nodata else repr(nodata)).encode() + b"\0"
    big = sum(int(x.sum()) + MARKS * x.size for x in sizes) > 4_000_000_000
    first = 16 if big else 8
    plans, at = [], first + len(GHOST) + -(first + len(GHOST)) % 8
    for n, (w, h) in enumerate(levels):
        k = sizes[n].size
        entries = [(SUBFILE, 4, (int(n > 0),)), (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (32,)), (COMPRESSION, 3, (how,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), *[(PREDICTOR, 3, (3,))] * (how != LZW), (TILE_WIDTH, 3, (tile,)), (TILE_HEIGHT, 3, (tile,)), (TILE_OFFSETS, 16 if big else 4, (0,) * k), (TILE_COUNTS, 4, tuple(sizes[n].ravel().tolist())), (FORMAT, 3, (3,))]
        if n == 0:
            places = [(t, kind, (v[0].encode("latin-1") + b"\0" if kind == 2 else v)) for (t, kind), v in zip(GEO_TAGS, geo, strict=False) if v]
            entries += sorted(places)
        entries.append((NODATA, 2, text))
        size = (8 + 20 * len(entries) + 8) if big else (2 + 12 * len(entries) + 4)
        extra = sum(x for x in (len(v) * SIZES[kind] for _, kind, v in entries) if x > (8 if big else 4))
        plans.append((entries, at, size))
        at += size + extra + (-(size + extra) % 8)
    offsets: list[np.ndarray] = [np.zeros(0, np.int64)] * len(levels)
    end = at
    for n in reversed(range(len(levels))):
        flat = sizes[n].ravel().astype(np.int64)
        each = np.where(flat > 0, flat + MARKS, 0)
        offsets[n] = np.where(flat > 0, end + np.cumsum(each) - each + 4, 0)
        end += int(each.sum())
    out = bytearray(at)
    head = b"II" + (struct.pack("<HHHQ", 43, 8, 0, plans[0][1]) if big else struct.pack("<HI", 42, plans[0][1])) + GHOST
    out[: len(head)] = head
    for n, (entries, start, size) in enumerate(plans):
        body, extra, room = b"", b"", 8 if big else 4
        for tag, kind, v in entries:
            v = offsets[n].tolist() if tag == TILE_OFFSETS else v
            raw = v if kind == 2 else struct.pack(f"<{len(v)}{CODES[kind]}", *v)
            if len(raw) > room:
                place, extra = start + size + len(extra), extra + raw
                raw = struct.pack("<Q" if big else "<I", place)
            body += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(v)) + raw.ljust(room, b"\0")
        follows = plans[n + 1][1] if n + 1 < len(plans) else 0
        whole = struct.pack("<Q" if big else "<H", len(entries)) + body + struct.pack("<Q" if big else "<I", follows) + extra
        out[start : start + len(whole)] = whole
    return bytes(out)


def tile_grids(width: int, height: int, tile: int = 512) -> list[tuple[int, int]]:
    """Rows and columns of tiles on each level."""
    side, levels = pyramid(width, height, tile)
    return [(-(-h // side), -(-w // side)) for w, h in levels]


def in_file(grids: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(level, row, column) of tiles as they follow in a file: small overviews first, rows of tiles from above."""
    for n in reversed(range(len(grids))):
        for r in range(grids[n][0]):
            for c in range(grids[n][1]):
                yield n, r, c


def write_cog(path: str, rows: Callable[[int, int], np.ndarray], width: int, height: int, geo: tuple = (None, None, None), tile: int = 512, nodata: float = float("nan"), how: int = DEFLATE) -> None:
    """A small float32 cloud-optimized GeoTIFF from ``rows(y, h)``, which gives rows of the full image; overviews take every second row and column.

    For one image that a process writes by itself, such as test data; its packed tiles
    are held in memory. ``write_rasters`` writes those of tables.
    """
    side, levels = pyramid(width, height, tile)
    grids = tile_grids(width, height, tile)
    sizes, tiles = [np.zeros(g, np.int64) for g in grids], {}
    for level, r, c in in_file(grids):
        step, h = 1 << level, min(side, levels[level][1] - r * side)
        picked = [rows(min(height - 1, (r * side + i) * step), 1) for i in range(h)] if level else [rows(r * side, h)]
        part = np.concatenate(picked)[:, ::step][:, c * side : (c + 1) * side]
        cells = np.full((side, side), nodata, "<f4")
        cells[: part.shape[0], : part.shape[1]] = part
        tiles[level, r, c] = packed_tile(cells, how)
        sizes[level][r, c] = len(tiles[level, r, c])
    part_path = f"{path}.part"
    with open(part_path, "wb") as f:
        f.write(heading(sizes, width, height, geo, tile, nodata, how))
        for key in in_file(grids):
            f.write(marked(tiles[key]))
    os.replace(part_path, path)


def cog_faults(f: BinaryIO | str, full: bool = False) -> list[str]:
    """What keeps a file (or its local path) from being a cloud-optimized GeoTIFF; empty if nothing does.

    With ``full`` also what its structural metadata promise is checked tile by tile: the
    size before each tile, its last bytes again behind it, and the order of tiles.
    """
    if isinstance(f, str):
        with open(f, "rb") as opened:
            return cog_faults(opened, full)
    f.seek(0)
    images = directories(f)
    out, first = [], images[0]
    if not first.tiled:
        out.append("not tiled")
    if max(first.width, first.height) > 512 and len(images) < 2:
        out.append("no overviews")
    for n, i in enumerate(images):
        if i.one(COMPRESSION) not in (NONE, LZW, DEFLATE, OLD_DEFLATE, ZSTD, PACKBITS) or not i.tiled or len(i.tags[TILE_OFFSETS]) != -(-i.width // i.block[1]) * -(-i.height // i.block[0]):
            out.append(f"directory {n} isn't a full set of tiles")
        if n and (i.width, i.height) != (-(-images[n - 1].width // 2), -(-images[n - 1].height // 2)):
            out.append(f"overview {n} isn't half as large as the one before")
    starts = [min([x for x in i.tags[TILE_OFFSETS] if x], default=0) for i in images if i.tiled]
    starts = [x for x in starts if x]
    if starts and max(i.at for i in images) > min(starts):
        out.append("directories lie behind tiles")
    if starts != sorted(starts, reverse=True):
        out.append("overviews lie behind the full image")
    if full and not out:
        out += _broken_promises(f, images)
    return out


def _broken_promises(f: BinaryIO, images: list[Image]) -> list[str]:
    f.seek(0)
    head = f.read(16)
    at = 16 if struct.unpack(images[0].order + "H", head[2:4])[0] == 43 else 8
    f.seek(at)
    title = f.read(len(GHOST) - len(STRUCTURE))
    if not title.startswith(b"GDAL_STRUCTURAL_METADATA_SIZE="):
        return ["no structural metadata"]
    says = f.read(int(title[30:36])).decode("latin-1")
    facts = dict(x.split("=", 1) for x in says.strip().splitlines() if "=" in x)
    out = []
    if facts.get("KNOWN_INCOMPATIBLE_EDITION") == "YES":
        out.append("edited since it was laid out")
    for n, i in enumerate(images):
        spots = [(k, o, c) for k, (o, c) in enumerate(zip(i.tags[TILE_OFFSETS], i.tags[TILE_COUNTS], strict=True)) if c]
        if facts.get("BLOCK_ORDER") == "ROW_MAJOR" and [o for _, o, _ in spots] != sorted(o for _, o, _ in spots):
            out.append(f"the tiles of directory {n} aren't in row order")
        for k, o, c in spots:
            f.seek(o - 4)
            raw = f.read(c + MARKS)
            if facts.get("BLOCK_LEADER") == "SIZE_AS_UINT4" and struct.unpack("<I", raw[:4])[0] != c:
                out.append(f"tile {k} of directory {n} has another size before it")
            if facts.get("BLOCK_TRAILER") == "LAST_4_BYTES_REPEATED" and raw[c : c + 4] != raw[c + 4 :]:
                out.append(f"the last bytes of tile {k} of directory {n} aren't repeated")
    return out
