"""How images find their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The colours of the land cover classes, in order of class id.
PALETTE = ((255, 255, 255), (0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0))


def by_id(labels: DataFrame, images: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pairs, and the labels without an image."""
    return labels.join(images, key), labels.join(images, key, "left_anti")


def numbered(rows: DataFrame, order: list[Column], name: str = "rn", bucket: str | None = None) -> DataFrame:
    """rows with their number, from 1, in the order (within a bucket, if given)."""
    window = Window.partitionBy(*([bucket] if bucket else [])).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window).cast("long"))


def zipped(a: DataFrame, order_a: list[Column], b: DataFrame, order_b: list[Column], bucket: str | None = None) -> DataFrame:
    """The first of a with the first of b and so on; the longer side's rest is left out. The numbers are dealt in one
    task unless a bucket, present on both sides, splits the work."""
    keys = ["rn", *([bucket] if bucket else [])]
    return numbered(a, order_a, bucket=bucket).join(numbered(b, order_b, bucket=bucket), keys)


def palette_ids(pixels: DataFrame) -> DataFrame:
    """pixels (red, green, blue) with class_id; a colour that is not in the palette has class 0."""
    table = pixels.sparkSession.createDataFrame([(*rgb, k) for k, rgb in enumerate(PALETTE)], "red int, green int, blue int, class_id int")
    return pixels.join(F.broadcast(table), ["red", "green", "blue"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))


def stacked(a: Column, b: Column) -> Column:
    """The features of both, one after the other."""
    return F.concat(a, b)
