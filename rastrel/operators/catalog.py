"""Scene catalogues: which scenes serve a region, and their composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles


def meeting(regions: DataFrame, scenes: DataFrame, cell: float = 1.0) -> DataFrame:
    """region_id, scene_id of boxes (xmin, ymin, xmax, ymax) that meet.

    Both sides are dealt to the cells of a grid that they touch and joined on the cell, so that no pair is looked at
    that is not near; a pair counts only in the first cell that both touch.
    """
    def dealt(boxes: DataFrame, name: str) -> DataFrame:
        span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
        out = boxes.select(F.col(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")], F.explode(span("xmin", "xmax")).alias("gx"), span("ymin", "ymax").alias("_ys"))
        return out.withColumn("gy", F.explode("_ys")).drop("_ys")

    both = dealt(regions, "region").join(dealt(scenes, "scene"), ["gx", "gy"])
    meet = (F.col("region_xmin") <= F.col("scene_xmax")) & (F.col("scene_xmin") <= F.col("region_xmax")) & (F.col("region_ymin") <= F.col("scene_ymax")) & (F.col("scene_ymin") <= F.col("region_ymax"))
    first = (F.col("gx") == F.floor(F.greatest("region_xmin", "scene_xmin") / cell)) & (F.col("gy") == F.floor(F.greatest("region_ymin", "scene_ymin") / cell))
    return both.where(meet & first).select("region_id", "scene_id")


def chosen(scenes: DataFrame, start: str, end: str, most_cloud: float) -> DataFrame:
    """scenes with a date from start up to but not including end and less cloud than most_cloud; a region without
    such a scene keeps all of its own."""
    fits = (F.col("acq_date") >= F.lit(start).cast("date")) & (F.col("acq_date") < F.lit(end).cast("date")) & (F.col("cloud_pct") < most_cloud)
    marked = scenes.withColumn("fits", F.coalesce(fits, F.lit(False)))
    served = marked.where("fits").select(F.col("region").alias("_served"), F.lit(True).alias("_any")).distinct()
    both = marked.join(served, F.col("region").eqNullSafe(F.col("_served")), "left")
    return both.where("fits or _any is null").drop("_served", "_any")


def composite(observations: DataFrame, *keys: str) -> DataFrame:
    """The median of v by the keys, and the number of observations."""
    return quantiles(observations, "v", {"v": 0.5}, *keys).withColumnRenamed("n", "n_obs")


def pending(wanted: DataFrame, outputs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """wanted (name) without the names for which an output (name, kind) of every kind is there."""
    done = outputs.where(F.col("kind").isin(*kinds)).groupBy("name").agg(F.countDistinct("kind").alias("n")).where(F.col("n") == len(kinds))
    return wanted.join(done, "name", "left_anti")


def tallies(results: DataFrame) -> DataFrame:
    """One row: how many results (status) are ok, skipped and failed."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "skipped", "failed")])
