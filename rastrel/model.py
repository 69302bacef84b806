"""Tiles, pairs, scenes and training logs as DataFrames, and how the given tables stand in for them.

A tile is a row with its pixels in one array, row by row: what is elementwise then needs no shuffle. The pixel form, a
row per pixel, is for what is keyed by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stand-in tiles are 8 x 8.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, site, v: an embedding is an 8 x 8 tile, its label the site."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), F.col("label").alias("site"), F.col("embedding").cast("array<double>").alias("v"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, site, t, p: a tile as target and the next one as prediction."""
    every = tiles(spark, sf_dir)
    return every.withColumnRenamed("v", "t").join(every.select((F.col("tile_id") - 1).alias("tile_id"), F.col("v").alias("p")), "tile_id")


def pixels(tile_rows: DataFrame, *keys: str, side: int = SIDE, value: str = "v") -> DataFrame:
    """keys, r, c, value: a row per pixel."""
    flat = tile_rows.select(*keys, F.posexplode(value).alias("_i", value))
    return flat.select(*keys, (F.col("_i") / side).cast("int").cast("long").alias("r"), (F.col("_i") % side).cast("long").alias("c"), value)


def tile_values(expr: Column, *keys: str) -> list[Column]:
    """Selects keys, i and v, a row per element of an array expression."""
    return [*[F.col(k) for k in keys], F.posexplode(expr).alias("i", "v")]


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, region, acq_date, cloud_pct, v: an event is a scene over the region of its user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scene_id"), F.pmod("user_id", F.lit(30)).alias("region"), F.to_date("ts").alias("acq_date"), F.pmod(F.col("value"), F.lit(100.0)).alias("cloud_pct"), F.col("value").alias("v"), F.col("event_type").alias("band")
    )


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, iter, n, metric, value: an event is an iteration of its day's epoch."""
    return table(spark, sf_dir, "events").select(
        F.dayofmonth("ts").cast("long").alias("epoch"), F.col("event_id").alias("iter"), (F.pmod("event_id", F.lit(4)) + 1).alias("n"), F.col("event_type").alias("metric"), F.col("value")
    )


def class_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px_id, y_true, y_pred."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("px_id"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
