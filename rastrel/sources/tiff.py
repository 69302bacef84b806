"""TIFF rasters with georeferences: strips or tiles, uncompressed, LZW or deflated, with either predictor, integers and
floats, any band count."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, BANDS, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, NO_DATA = 317, 322, 323, 324, 325, 42113
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS = 33550, 33922, 34264, 34735
_EPSG_KEYS = (3072, 2048)
SCHEMA = "path string, width int, height int, n_bands int, dtype string, gt struct<x0:double,dx:double,rx:double,y0:double,ry:double,dy:double>, crs string, no_data double, bands array<array<double>>, error string"


@dataclass
class Raster:
    values: np.ndarray  # bands, rows, columns
    gt: tuple[float, ...]  # x0, dx, rx, y0, ry, dy
    crs: str | None
    no_data: float | None = None


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        size = _SIZES.get(kind, 1) * count
        raw = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
        tags[tag] = (bytes(raw),) if kind == 2 else struct.unpack(f"{order}{count}{_CODES[kind]}", raw) if kind in _CODES else ()
    return order, tags


def _number(text: tuple | None) -> float | None:
    try:
        return float(text[0].rstrip(b"\0 ")) if text else None
    except ValueError:
        return None


def header(data: bytes) -> dict:
    """width, height, n_bands, dtype, gt, crs."""
    order, tags = _tags(data)
    kind = _KINDS[tags.get(FORMAT, (1,))[0]]
    gt = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIE_POINT]
        gt = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    keys = tags.get(GEO_KEYS, ())
    epsg = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    code = next((epsg[k] for k in _EPSG_KEYS if k in epsg), None)
    return {"order": order, "tags": tags, "width": tags[WIDTH][0], "height": tags[HEIGHT][0], "n_bands": tags.get(BANDS, (1,))[0], "dtype": f"{kind}{tags.get(BITS, (8,))[0] // 8}", "gt": gt, "crs": f"EPSG:{code}" if code else None, "no_data": _number(tags.get(NO_DATA))}


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; they widen one code early."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or (code == len(table) and not last):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress}


def _unpredicted(raw: bytes, shape: tuple[int, int, int], kind: np.dtype, predictor: int) -> np.ndarray:
    """rows x columns x samples of a block, from differences if there is a predictor."""
    rows, columns, samples = shape
    need = rows * columns * samples * kind.itemsize
    if len(raw) < need:
        raise ValueError("block cut short")
    raw = raw[:need]
    if predictor == 1:
        return np.frombuffer(raw, kind).reshape(shape)
    if predictor == 2:
        whole = np.frombuffer(raw, kind).reshape(shape).astype(kind.newbyteorder("="))
        return np.cumsum(whole, axis=1, dtype=whole.dtype)
    if predictor == 3 and kind.kind == "f":  # the bytes of a row's numbers in planes, the highest first, as differences
        planes = np.frombuffer(raw, np.uint8).reshape(rows, -1, samples).cumsum(1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    raise ValueError(f"predictor {predictor} is not supported")


def decode(data: bytes) -> Raster:
    """ValueError for what is not a TIFF file, is broken, or is packed in another way."""
    try:
        return _decode(data)
    except (KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
        raise ValueError(f"broken TIFF file: {e!r}") from e


def _decode(data: bytes) -> Raster:
    h = header(data)
    tags = h["tags"]
    packing, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if packing not in _UNPACK:
        raise ValueError(f"compression {packing} is not supported")
    height, width, bands = h["height"], h["width"], h["n_bands"]
    tiled = TILE_OFFSETS in tags
    high, wide = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(height, tags.get(ROWS, (height,))[0]), width)
    places = list(zip(*((tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])), strict=True))
    apart = tags.get(PLANAR, (1,))[0] == 2
    down, across, kind = -(-height // high), -(-width // wide), np.dtype(h["order"] + h["dtype"])
    if len(places) < down * across * (bands if apart else 1):
        raise ValueError("blocks are missing")
    values = np.zeros((bands, height, width), kind.newbyteorder("="))
    for k, (at, size) in enumerate(places[: down * across * (bands if apart else 1)]):
        band, place = divmod(k, down * across)
        r, c = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - r)
        block = _unpredicted(_UNPACK[packing](data[at : at + size]), (rows, wide, 1 if apart else bands), kind, predictor)
        block = block[: height - r, : width - c].transpose(2, 0, 1)
        values[band : band + 1 if apart else None, r : r + block.shape[1], c : c + block.shape[2]] = block
    return Raster(values, h["gt"], h["crs"], h["no_data"])


def encode(raster: Raster) -> bytes:
    """One deflated strip per band, little-endian."""
    values = np.ascontiguousarray(raster.values)
    n, height, width = values.shape
    little = values.dtype.newbyteorder("<")
    strips = [zlib.compress(band.astype(little).tobytes()) for band in values]
    x0, dx, rx, y0, ry, dy = raster.gt
    entries: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (values.dtype.itemsize * 8,) * n), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (OFFSETS, 4, (0,) * n), (BANDS, 3, (n,)), (ROWS, 4, (height,)),
        (COUNTS, 4, tuple(map(len, strips))), (PLANAR, 3, (2,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[values.dtype.kind],) * n), (TRANSFORM, 12, (dx, rx, 0.0, x0, ry, dy, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    if raster.no_data is not None:
        entries.append((NO_DATA, 2, tuple(f"{raster.no_data:.17g}".encode() + b"\0")))
    if raster.crs:
        entries.append((GEO_KEYS, 3, (1, 1, 0, 1, 3072, 0, 1, int(raster.crs.removeprefix("EPSG:")))))
    entries.sort(key=lambda e: e[0])
    extra_at = 8 + 2 + 12 * len(entries) + 4
    sizes = [_SIZES[kind] * len(v) for _, kind, v in entries]
    body_at = extra_at + sum(s + s % 2 for s in sizes if s > 4)
    offsets = tuple(body_at + sum(map(len, strips[:k])) for k in range(n))
    table, extra = [], b""
    for (tag, kind, v), size in zip(entries, sizes, strict=True):
        raw = struct.pack(f"<{len(v)}{_CODES[kind]}", *(offsets if tag == OFFSETS else v))
        if size > 4:
            table.append(struct.pack("<HHII", tag, kind, len(v), extra_at + len(extra)))
            extra += raw + b"\0" * (size % 2)
        else:
            table.append(struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0"))
    return b"".join([b"II*\0", struct.pack("<I", 8), struct.pack("<H", len(entries)), *table, b"\0" * 4, extra, *strips])


def read(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """A row per TIFF file: header columns, and the bands' pixels unless pixels is False. A file that can't be read is a
    row with its error and nothing else."""
    names = ["path", "width", "height", "n_bands", "dtype", "gt", "crs", "no_data", "bands", "error"]

    def row(name: str, content: bytes) -> tuple:
        try:
            raster = decode(content) if pixels else None
            h = header(content)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return name, *[None] * 8, str(e)
        gt = dict(zip(("x0", "dx", "rx", "y0", "ry", "dy"), map(float, h["gt"]), strict=True))
        bands = [b.ravel().astype(float) for b in raster.values] if pixels else None
        return name, h["width"], h["height"], h["n_bands"], h["dtype"], gt, h["crs"], h["no_data"], bands, None

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                out = pd.DataFrame([row(name, content)], columns=names)
                yield out.astype({c: "Int32" for c in ("width", "height", "n_bands")})

    files = spark.read.format("binaryFile").load(path).where(r"lower(path) rlike '\\.tiff?$'")
    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, n_bands, bands (red, green, blue and opacity if there; or one) of the JPEG, PNG, GIF and BMP files
    under path, which Spark's image source decodes. Files that are no images are left out."""
    data = F.col("image.data")
    size, n = F.col("image.width") * F.col("image.height"), F.col("image.nChannels")

    def band(k: Column) -> Column:
        at = F.when(k < 3, F.least(F.lit(2), n - 1) - k).otherwise(k)
        pixels = F.sequence(F.lit(0), size - 1)
        return F.transform(pixels, lambda i: F.conv(F.hex(F.substring(data, i * n + at + 1, 1)), 16, 10).cast("double"))

    rows = spark.read.format("image").option("dropInvalid", True).load(path).where("image.height > 0")
    bands = F.transform(F.sequence(F.lit(0), n - 1), band)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), n.alias("n_bands"), bands.alias("bands"))


def _content(t: pd.Series) -> bytes:
    values = np.stack([np.asarray(b, float).reshape(t.height, t.width) for b in t.bands]).astype(t.dtype)
    gt = t.gt if isinstance(t.gt, dict) else t.gt.asDict()
    return encode(Raster(values, tuple(gt[k] for k in ("x0", "dx", "rx", "y0", "ry", "dy")), t.crs))


_TILE = ("name", "height", "width", "dtype", "gt", "crs", "bands")


def encoded(tiles: DataFrame) -> DataFrame:
    """name, content: the GeoTIFF files of tiles (name, height, width, dtype, gt, crs, bands)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"name": frame["name"], "content": [_content(t) for t in frame.itertuples(index=False)]})

    return tiles.select(*_TILE).mapInPandas(pack, "name string, content binary")


def write(tiles: DataFrame, folder: str) -> int:
    """Writes a GeoTIFF file folder/name for each of tiles (see encoded), as sinks.files() does, and returns how many."""
    return sinks.files(encoded(tiles), folder)
