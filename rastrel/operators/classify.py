"""Reports on classified pixels (y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pixels: DataFrame) -> DataFrame:
    """y_true, y_pred, n of the pairs that occur: as many rows as classes squared at most."""
    return pixels.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def report(pixels: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 of every class that is true or predicted somewhere; 0 for 0 / 0."""
    table = confusion(pixels)
    cells = table.select(F.explode(F.array(F.struct(F.col("y_true").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit"))
    sums = cells.groupBy(F.col("x.class").alias("class")).agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), (F.sum("hit") / 2).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    rated = sums.select("class", "support", share("hits", "predicted").alias("precision"), share("hits", "support").alias("recall"))
    return rated.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def agreement(pixels: DataFrame) -> DataFrame:
    """One row: n, overall accuracy, average recall, kappa (0 where chance agreement is 1)."""
    sides = confusion(pixels).select("n", (F.col("y_true") == F.col("y_pred")).alias("same"), F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("y_true").alias("class")), F.struct(F.lit("p").alias("side"), F.col("y_pred").alias("class")))).alias("x"))
    of = lambda side, *also: F.sum(F.when((F.col("x.side") == side) & (F.col("same") if also else F.lit(True)), F.col("n")).otherwise(0))
    margins = sides.groupBy("x.class").agg(of("t").alias("t"), of("p").alias("p"), of("t", "same").alias("hits"))
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("t").cast("double")), F.lit(0.0))
    sums = margins.agg(F.sum("t").alias("n"), F.sum("hits").alias("hits"), F.sum(F.col("t") * F.col("p")).alias("products"), F.avg(recall).alias("aa"))
    n = F.col("n").cast("double")
    po, pe = F.col("hits") / n, F.col("products") / (n * n)
    return sums.select("n", po.alias("oa"), "aa", F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)).alias("kappa"))
