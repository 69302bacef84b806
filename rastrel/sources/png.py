"""PNG files of grey or coloured tiles, eight bits a band."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COLOUR = {1: 0, 3: 2, 4: 6}


def encode(values: np.ndarray) -> bytes:
    """The file of bands x rows x columns of bytes: one band is grey, three are colours, the fourth is opacity."""
    if values.dtype != np.uint8 or values.ndim != 3 or len(values) not in _COLOUR:
        raise ValueError("1, 3 or 4 bands of bytes make a PNG file")
    n, height, width = values.shape
    lines = np.zeros((height, 1 + width * n), np.uint8)  # each line starts with its filter, 0
    lines[:, 1:] = values.transpose(1, 2, 0).reshape(height, width * n)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, _COLOUR[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encoded(tiles: DataFrame) -> DataFrame:
    """name, content: the PNG files of tiles (name, height, width, bands). Values are cut off below 0, above 255 and
    after the point; NaN is 0."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for height, width, bands in zip(frame["height"], frame["width"], frame["bands"], strict=True):
                values = np.stack([np.asarray(b, float).reshape(height, width) for b in bands])
                made.append(encode(np.clip(np.nan_to_num(values, nan=0.0), 0, 255).astype(np.uint8)))
            yield pd.DataFrame({"name": frame["name"], "content": made})

    return tiles.select("name", "height", "width", "bands").mapInPandas(pack, "name string, content binary")


def sheet(tiles: np.ndarray, columns: int, gap: int = 2) -> np.ndarray:
    """A contact sheet: a stack of tiles (bands x rows x columns each) in lines of columns, with gap black pixels around
    and between them; places without a tile are black."""
    count, bands, height, width = tiles.shape
    columns = max(1, min(columns, count))
    lines = -(-count // columns)
    out = np.zeros((bands, gap + lines * (height + gap), gap + columns * (width + gap)), tiles.dtype)
    for k, tile in enumerate(tiles):
        top, left = gap + k // columns * (height + gap), gap + k % columns * (width + gap)
        out[:, top : top + height, left : left + width] = tile
    return out


def sheets(tiles: DataFrame, number: str, columns: int = 8, most: int = 64) -> DataFrame:
    """name, content: contact sheets of tiles (number, height, width, bands), all of one size. Numbers are unique whole
    ones; each run of `most` numbers, from 0, is a sheet sheet_<k>.png, whose tiles are in their order without places
    for missing ones. Rows without a number are on no sheet. ValueError if a sheet would hold no tile."""
    if most < 1:
        raise ValueError("a sheet holds a tile at least")

    def pack(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(number).itertuples(index=False)
        stack = np.stack([np.stack([np.asarray(b, float).reshape(t.height, t.width) for b in t.bands]) for t in rows])
        stack = np.clip(np.nan_to_num(stack, nan=0.0), 0, 255).astype(np.uint8)
        return pd.DataFrame({"name": [f"sheet_{group[0]}.png"], "content": [encode(sheet(stack, columns))]})

    placed = tiles.where(F.col(number).isNotNull()).withColumn("_sheet", F.floor(F.col(number) / most).cast("long"))
    return placed.groupBy("_sheet").applyInPandas(pack, "name string, content binary")
