"""Windows over rasters: a sequence per axis, exploded. Every raster's windows come from its own row; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import shifted


def overlap_starts(length: Column, size: int, mode: str = "reference") -> Column:
    """The starts of windows that overlap so as to cover an axis: (length - 1) div size + 1 of them at equal whole
    steps. mode reference: the last may end before the axis does; cover: the last ends with it. Where the axis is
    shorter than a window there is one, at 0."""
    if mode not in ("reference", "cover"):
        raise ValueError("mode is reference or cover")
    n = F.floor((length - 1) / size).cast("int") + 1
    room = F.greatest(length - size, F.lit(0))
    step = F.when(n > 1, F.floor(room / F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(size)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(i * step, room).cast("int"))
    if mode == "reference":
        return starts
    return F.transform(starts, lambda s, i: F.when(i == n - 1, room.cast("int")).otherwise(s))


def overlap_grid(rasters: DataFrame, size: int = 256, mode: str = "reference") -> DataFrame:
    """raster_id, tile_idx (by rows), row0, col0 of rasters (raster_id, height, width)."""
    rows = rasters.select("raster_id", F.size(overlap_starts(F.col("width"), size, mode)).alias("_n"), F.posexplode(overlap_starts(F.col("height"), size, mode)).alias("_i", "row0"), overlap_starts(F.col("width"), size, mode).alias("_cols"))
    cells = rows.select("raster_id", "row0", "_i", "_n", F.posexplode("_cols").alias("_j", "col0"))
    return cells.select("raster_id", (F.col("_i") * F.col("_n") + F.col("_j")).cast("long").alias("tile_idx"), F.col("row0").cast("long").alias("row0"), F.col("col0").cast("long").alias("col0"))


def plain_grid(rasters: DataFrame, size_x: int = 500, size_y: int = 500) -> DataFrame:
    """raster_id, it, jt, x0, y0, name: windows side by side, those at the far edges overrun."""
    count = lambda length, size: F.ceil(F.col(length) / size).cast("int")
    across = rasters.select("raster_id", F.explode(F.sequence(F.lit(0), count("width", size_x) - 1)).alias("it"), count("height", size_y).alias("_rows"))
    both = across.select("raster_id", "it", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("jt"))
    return both.select("raster_id", F.col("it").cast("long").alias("it"), F.col("jt").cast("long").alias("jt"), (F.col("it") * size_x).cast("long").alias("x0"), (F.col("jt") * size_y).cast("long").alias("y0"), F.format_string("tile_%d_%d", "it", "jt").alias("name"))


def metric_grid(rasters: DataFrame, size: float, overlap: float = 0.0) -> DataFrame:
    """raster_id, ix, iy, xmin, ymin, xmax, ymax, name of the tiles of a grid snapped to whole steps that touch the
    bounds (xmin, ymin, xmax, ymax). ValueError if the step would not be positive."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be less than the tile")
    origin = lambda low: F.floor(F.col(low) / step) * step
    count = lambda low, high: F.greatest(F.ceil((F.col(high) - origin(low)) / step), F.lit(0)).cast("int")
    based = rasters.select("raster_id", "xmin", "ymin", "xmax", "ymax", origin("xmin").cast("double").alias("_x"), origin("ymin").cast("double").alias("_y"), count("xmin", "xmax").alias("_nx"), count("ymin", "ymax").alias("_ny"))
    across = based.where("_nx > 0 and _ny > 0").withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
    both = across.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    x, y = F.col("_x") + F.col("ix") * step, F.col("_y") + F.col("iy") * step
    outside = (x >= F.col("xmax")) | (y >= F.col("ymax")) | (x + size <= F.col("xmin")) | (y + size <= F.col("ymin"))
    return both.where(~outside).select("raster_id", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"), F.format_string("tile_%04d_%04d", "ix", "iy").alias("name"))


def centred_tile(rasters: DataFrame, size: float) -> DataFrame:
    """raster_id, x0, y0, x1, y1 of the tile around the middle of the bounds."""
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return rasters.select("raster_id", (x - size / 2).alias("x0"), (y - size / 2).alias("y0"), (x + size / 2).alias("x1"), (y + size / 2).alias("y1"))


def georeferenced(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """cells (raster_id, tile_idx, row0, col0) with the geotransform gt of the window, from the raster's."""
    return cells.join(rasters.select("raster_id", "gt"), "raster_id").withColumn("gt", shifted(F.col("gt"), F.col("row0"), F.col("col0")))


def cut(values: Column, row0: Column, col0: Column, size: int, width: Column) -> Column:
    """The window's pixels out of a raster's array."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice(values, ((row0 + r) * width + col0 + 1).cast("int"), F.lit(size))))


def band_subset(bands: Column) -> Column:
    """The first three of three or four bands, else the first."""
    return F.when(F.size(bands).isin(3, 4), F.slice(bands, 1, 3)).otherwise(F.slice(bands, 1, 1))
