"""Neighbourhood operators on tiles held as arrays: each output pixel reads its own row's array, so nothing moves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import at, mean, places

#: The Sobel kernels, applied without flipping.
SOBEL_X = ((1, 0, -1), (2, 0, -2), (1, 0, -1))
SOBEL_Y = ((1, 2, 1), (0, 0, 0), (-1, -2, -1))


def correlate(v: Column, kernel: Sequence[Sequence[float]], height: int, width: int, outside: float | None = 0.0) -> Column:
    """Sums of kernel times neighbourhood, the same size as the tile, padded with outside (None: edge values)."""
    up, left = len(kernel) // 2, len(kernel[0]) // 2

    def one(r: Column, c: Column) -> Column:
        terms = [at(v, r + (i - up), c + (j - left), height, width, outside) * float(k) for i, row in enumerate(kernel) for j, k in enumerate(row) if k]
        out = terms[0]
        for t in terms[1:]:
            out += t
        return out

    return places(height, width, one)


def convolve(v: Column, kernel: Sequence[Sequence[float]], height: int, width: int) -> Column:
    """True convolution: the kernel is turned about."""
    return correlate(v, [list(row)[::-1] for row in list(kernel)[::-1]], height, width)


def sobel(v: Column, height: int, width: int) -> tuple[Column, Column]:
    return correlate(v, SOBEL_X, height, width), correlate(v, SOBEL_Y, height, width)


def pool(v: Column, by: int, height: int, width: int, how: str = "mean") -> Column:
    """Blocks of by x by pixels to one: their mean or max."""
    def block(r: Column, c: Column) -> Column:
        cells = F.array(*[F.get(v, (r * by + i) * width + c * by + j) for i in range(by) for j in range(by)])
        return F.array_max(cells) if how == "max" else mean(cells)

    return places(height // by, width // by, block)


def enlarge(v: Column, by: int, height: int, width: int) -> Column:
    """Each pixel repeated by x by times."""
    return places(height * by, width * by, lambda r, c: F.get(v, F.floor(r / by).cast("int") * width + F.floor(c / by).cast("int")))


def bilinear(v: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """Resampled between pixel centres, edges held."""
    def one(r: Column, c: Column) -> Column:
        y = F.greatest(F.lit(0.0), (r + 0.5) * (height / new_height) - 0.5)
        x = F.greatest(F.lit(0.0), (c + 0.5) * (width / new_width) - 0.5)
        r0, c0 = F.floor(y).cast("int"), F.floor(x).cast("int")
        fy, fx = y - r0, x - c0
        get = lambda dr, dc: at(v, r0 + dr, c0 + dc, height, width, None)
        return (get(0, 0) * (1 - fx) + get(0, 1) * fx) * (1 - fy) + (get(1, 0) * (1 - fx) + get(1, 1) * fx) * fy

    return places(new_height, new_width, one)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def warped(v: Column, gt: Column, height: int, width: int, to: Column, new_height: int, new_width: int, no_data: float | None = 0.0, fill: float = 0.0) -> Column:
    """The tile, placed by the geotransform gt, on the grid of new_height x new_width pixels placed by `to`: bilinear
    between pixel centres. Pixels that are missing, NaN or no_data, and those beyond the edge, have no weight; where
    none of the four has any, and outside the tile, it is fill. Both geotransforms may be rotated."""
    det = gt["dx"] * gt["dy"] - gt["rx"] * gt["ry"]

    def tap(q: Column, dr: int, dc: int) -> Column:
        here = at(v, q["r0"] + dr, q["c0"] + dc, height, width, float("nan"))
        down, across = (q["fy"] if dr else 1 - q["fy"]), (q["fx"] if dc else 1 - q["fx"])
        return F.struct(here.alias("value"), (down * across).alias("weight"))

    def one(r: Column, c: Column) -> Column:
        x = to["x0"] - gt["x0"] + (c + 0.5) * to["dx"] + (r + 0.5) * to["rx"]
        y = to["y0"] - gt["y0"] + (c + 0.5) * to["ry"] + (r + 0.5) * to["dy"]
        xy = F.struct(x.alias("x"), y.alias("y"))
        place = let(xy, lambda p: F.struct(((p["y"] * gt["dx"] - p["x"] * gt["ry"]) / det).alias("row"), ((p["x"] * gt["dy"] - p["y"] * gt["rx"]) / det).alias("col")))
        return let(place, spot)

    def spot(p: Column) -> Column:
        r0, c0 = F.floor(p["row"] - 0.5).cast("int"), F.floor(p["col"] - 0.5).cast("int")
        corner = F.struct(r0.alias("r0"), c0.alias("c0"), (p["row"] - 0.5 - r0).alias("fy"), (p["col"] - 0.5 - c0).alias("fx"))
        taps = let(corner, lambda q: F.array(*[tap(q, dr, dc) for dr in (0, 1) for dc in (0, 1)]))
        known = F.filter(taps, lambda t: t["value"].isNotNull() & ~F.isnan(t["value"]) & ((t["value"] != no_data) if no_data is not None else F.lit(True)))
        start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("weight"))
        add = lambda s, t: F.struct((s["total"] + t["value"] * t["weight"]).alias("total"), (s["weight"] + t["weight"]).alias("weight"))
        made = F.aggregate(known, start, add, lambda s: F.when(s["weight"] > 0, s["total"] / s["weight"]).otherwise(F.lit(fill)))
        inside = (p["col"] >= 0) & (p["col"] <= width) & (p["row"] >= 0) & (p["row"] <= height)
        return F.when(inside, made).otherwise(F.lit(fill))

    return places(new_height, new_width, one)


def slopes(v: Column, height: int, width: int) -> tuple[Column, Column]:
    """Differences down and across: central inside, one-sided at the edges."""
    def along(dr: int, dc: int) -> Column:
        def one(r: Column, c: Column) -> Column:
            low = at(v, r - dr, c - dc, height, width, None)
            high = at(v, r + dr, c + dc, height, width, None)
            edge = ((r == 0) | (r == height - 1)) if dr else ((c == 0) | (c == width - 1))
            return (high - low) / F.when(edge, 1.0).otherwise(2.0)

        return places(height, width, one)

    return along(1, 0), along(0, 1)


def hillshade(v: Column, height: int, width: int, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.5) -> Column:
    """The cosine of the angle between the surface's normal and the light, at least 0."""
    import math

    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    light = (math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt))
    down, across = slopes(v, height, width)

    def shade(dy: Column, dx: Column) -> Column:
        nx, ny = -exaggeration * dx, exaggeration * dy
        return F.greatest(F.lit(0.0), (nx * light[0] + ny * light[1] + light[2]) / F.sqrt(nx * nx + ny * ny + 1.0))

    return F.zip_with(down, across, shade)
