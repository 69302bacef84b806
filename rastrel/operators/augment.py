"""Augmentations. What is a formula per pixel is an expression; what needs a whole tile at once is numpy over a batch
of tiles, a batch of a partition at a time and never a group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import normal


def noisy(v: Column, sigma: float, seed: object, *keys: Column) -> Column:
    """Gaussian noise, kept within 0..255, fractions cut off."""
    return F.transform(v, lambda x, i: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x + sigma * normal(seed, *keys, i)))).cast("int"))


def fogged(v: Column, fractal: Column, severity: float) -> Column:
    """Pixels of 0..255 under a fog map of 0..1, scaled so that the brightest stays within the range."""
    top = F.array_max(F.transform(v, lambda x: x / 255.0))
    mixed = lambda t: F.zip_with(v, fractal, lambda x, f: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x / 255.0 + severity * f) * t / (t + severity))) * 255.0)
    return F.element_at(F.transform(F.array(top), mixed), 1)


def draws(seeds: np.ndarray, count: int, name: str = "plasma") -> np.ndarray:
    """count numbers of -1..1 for each seed, a row each: the k-th from the first 32 bits of MD5 of "name|seed|k"."""
    digest = lambda s, k: int.from_bytes(hashlib.md5(f"{name}|{s}|{k}".encode()).digest()[:4], "big")
    bits = np.array([[digest(int(s), k) for k in range(count)] for s in seeds], float).reshape(len(seeds), count)
    return bits / 2**31 - 1


def plasma(side: int, decay: float, noise: np.ndarray) -> np.ndarray:
    """Fractals of 0..1, one for each row of noise (side * side numbers of -1..1); side is a power of two.

    Midpoint displacement on a torus. Level k knows the points whose coordinates are multiples of a gap of
    side / 2^k; points half a gap off in both coordinates become the mean of the four known ones around them, then those
    half a gap off in one coordinate the mean of their four neighbours at that distance. Every new point is
    displaced by a * U(-a, a) with the level's amplitude a = 100 / decay^k.
    """
    if side & (side - 1):
        raise ValueError("side must be a power of two")
    field, used = np.zeros((len(noise), side, side)), 0
    for level in range(side.bit_length() - 1):
        gap, amplitude = side >> level, 100.0 / decay**level
        half = gap // 2
        known = np.arange(0, side, gap)
        between = known + half
        diagonal = [(-half, -half), (-half, half), (half, -half), (half, half)]
        straight = [(-half, 0), (half, 0), (0, -half), (0, half)]
        for rows, columns, around in ((between, between, diagonal), (known, between, straight), (between, known, straight)):
            mean = sum(field[:, ((rows + y) % side)[:, None], (columns + x) % side] for y, x in around) / 4
            shift = noise[:, used : used + len(rows) * len(columns)].reshape(mean.shape)
            field[:, rows[:, None], columns] = mean + amplitude * amplitude * shift
            used += len(rows) * len(columns)
    field -= field.min((1, 2), keepdims=True)
    return field / np.maximum(field.max((1, 2), keepdims=True), 1e-12)


def plasma_size(height: int, width: int) -> int:
    return 1 << max(0, (max(height, width) - 1).bit_length())


def motion_path(rng: np.random.Generator, intensity: float, length: int = 32) -> np.ndarray:
    """Complex places of a camera that shakes: steps whose angles wander, summed up and centred."""
    angles = np.cumsum(rng.uniform(-1, 1, length) * intensity * np.pi)
    places = np.cumsum(rng.beta(2, 5, length) * np.exp(1j * angles))
    return places - places.mean()


def motion_kernel(rng: np.random.Generator, intensity: float, side: int = 5) -> np.ndarray:
    """The path drawn on a side x side raster with bilinear weights; its sum is 1."""
    path = motion_path(rng, intensity)
    reach = max(np.abs(path.real).max(), np.abs(path.imag).max(), 1e-9)
    y, x = (path.imag / reach + 1) * (side - 1) / 2, (path.real / reach + 1) * (side - 1) / 2
    out = np.zeros((side + 1, side + 1))
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    for dr in (0, 1):
        for dc in (0, 1):
            np.add.at(out, (r + dr, c + dc), np.abs(1 - dr - (y - r)) * np.abs(1 - dc - (x - c)))
    out = out[:side, :side]
    return out / out.sum()


def convolve(tiles: np.ndarray, kernel: np.ndarray, mode: str = "same") -> np.ndarray:
    """True convolution of a tile or a stack of them, with one kernel or one for each; same: padded with zeros, valid:
    whole neighbourhoods only."""
    k = kernel[..., ::-1, ::-1]
    high, wide = k.shape[-2:]
    up, left = (high - 1) // 2, (wide - 1) // 2
    around = [(0, 0)] * (tiles.ndim - 2) + [(up, high - 1 - up), (left, wide - 1 - left)]
    padded = np.pad(tiles, around) if mode == "same" else tiles
    windows = np.lib.stride_tricks.sliding_window_view(padded, (high, wide), axis=(-2, -1))
    return np.einsum("...ijkl,...kl->...ij", windows, k)


def _taps(n: int, m: int, kernel: Callable[[np.ndarray], np.ndarray], support: float) -> np.ndarray:
    """The m x n matrix that resamples n places to m, widened when it makes fewer."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    weights = kernel((np.arange(n)[None, :] - centre[:, None]) / scale) * (np.abs(np.arange(n)[None, :] - centre[:, None]) < support * scale)
    return weights / weights.sum(1, keepdims=True)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def resample(tiles: np.ndarray, height: int, width: int, how: str = "lanczos") -> np.ndarray:
    """A tile or a stack of them to another size by separable kernels: cubic (2 places to a side) or lanczos (3)."""
    kernel, support = {"cubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}[how]
    return _taps(tiles.shape[-2], height, kernel, support) @ tiles @ _taps(tiles.shape[-1], width, kernel, support).T


def down_and_up(tiles: np.ndarray, scale: float) -> np.ndarray:
    """Made smaller by scale and brought back, cubic both ways."""
    height, width = tiles.shape[-2:]
    return resample(resample(tiles, max(1, int(height * scale)), max(1, int(width * scale)), "cubic"), height, width, "cubic")


def rotated(tiles: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Each tile of a stack turned about its middle by its angle, quadratic B-spline of the neighbours, 0 outside, same
    size."""
    h, w = tiles.shape[-2:]
    t, nth = np.radians(np.asarray(degrees, float))[:, None, None], np.arange(len(tiles))[:, None, None]
    r, c = np.indices((h, w))
    y, x = r - (h - 1) / 2, c - (w - 1) / 2
    sy, sx = np.cos(t) * y + np.sin(t) * x + (h - 1) / 2, -np.sin(t) * y + np.cos(t) * x + (w - 1) / 2
    ry, rx = np.rint(sy).astype(int), np.rint(sx).astype(int)
    out, total = np.zeros(tiles.shape), np.zeros(tiles.shape)
    spline = lambda d: np.where(np.abs(d) <= 0.5, 0.75 - d * d, np.where(np.abs(d) <= 1.5, 0.5 * (1.5 - np.abs(d)) ** 2, 0.0))
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            rr, cc = ry + dr, rx + dc
            weight = spline(sy - rr) * spline(sx - cc)
            inside = (rr >= 0) & (rr < h) & (cc >= 0) & (cc < w)
            out += np.where(inside, weight * tiles[nth, np.clip(rr, 0, h - 1), np.clip(cc, 0, w - 1)], 0)
            total += weight
    return out / total


def per_batch(tiles: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], height: int, width: int) -> DataFrame:
    """tiles (tile_id, v) with v = f(tile ids, stack of tiles), a stack for each batch."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                stack = np.stack([np.asarray(v, float) for v in frame["v"]]).reshape(-1, height, width)
                done = f(frame["tile_id"].to_numpy(), stack)
                yield pd.DataFrame({"tile_id": frame["tile_id"], "v": list(done.reshape(len(frame), -1))})

    return tiles.select("tile_id", "v").mapInPandas(apply, "tile_id long, v array<double>")
