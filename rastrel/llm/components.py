"""Connected components of a graph too large for one machine: alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Every step keeps the components and brings
each node nearer to the least node of its own; minima are combined before the shuffle, so a hub is not gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v: links to the least neighbour m of u the greater (large) or lesser neighbours of u."""
    seen = edges.union(edges.select("v", "u")) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    least = least.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so that the join can split a hub
    moved = seen.join(least, seen["u"] == least["_u"])
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
    return out.distinct()


def _finished(edges: DataFrame) -> bool:
    """Whether every node has one link at most to a lesser node, and that one none: then the lesser node is the root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    return not nodes.where("up > 1 or up > 0 and low = 0").limit(1).count()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, root for every node of links (a, b: longs), and of known, an earlier result, that they add to: root is
    the least node that can be reached. Links of a node to itself and repeated ones count for nothing, nor do those
    with a null end; without links there are no rows; other columns are ignored."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        edges = edges.union(known.where("node <> root").select("node", "root"))
    edges = materialise(edges.distinct(), "edges")
    while not _finished(edges):
        edges = materialise(_stars(_stars(edges, True), False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
