"""Training logs: running means, epoch means, schedules of what is written when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Whole numbers of the order to a stretch of a running window.
STRETCH = 100_000


def running_mean(log: DataFrame, *keys: str, stretch: int = STRETCH) -> DataFrame:
    """log (iter, n, value) with the sum, count and mean of the values so far within the keys, weighted by n. Sums are
    decimal, so that they do not depend on the order in which partitions come.

    A task holds a stretch of iterations of a key, not all of them: what the stretches before it add up to is worked out
    on one row for each. Null keys are keys, and rows without an iteration come first.
    """
    rows = log.select(*keys, "iter", "n", (F.col("value").cast("decimal(18,2)") * F.col("n")).alias("_worth"))
    rows = rows.withColumn("_stretch", F.floor(F.col("iter") / stretch))
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum("_worth").alias("_worth"), F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_stretch").alias("_of"),
        F.coalesce(F.sum("_worth").over(before), F.lit(0)).alias("_worth_before"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
    )
    same = F.col("_stretch").eqNullSafe(F.col("_of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    so_far = Window.partitionBy(*keys, "_stretch").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", F.sum("_worth").over(so_far).alias("_own"), F.sum("n").over(so_far).alias("_count"))
    placed = own.join(starts, same)
    worth = (F.coalesce("_own", F.lit(0)) + F.col("_worth_before")).cast("double")
    count = F.coalesce("_count", F.lit(0)) + F.col("_n_before")
    return placed.select(*keys, "iter", worth.alias("total"), count.alias("count"), F.try_divide(worth, count).alias("mean"))


def elapsed(log: DataFrame, key: str, at: str, order: str, seconds: int = 3600) -> DataFrame:
    """key, order, us: microseconds since the row before within the key, by the time `at`, then order. The first row of
    a key, rows without a time, and what follows those alone have none and are left out. A task holds so many
    seconds of a key; the stretch before counts with its last time."""
    rows = log.where(F.col(at).isNotNull()).select(key, order, F.unix_micros(F.col(at)).alias("_us"))
    rows = rows.withColumn("_stretch", F.floor(F.col("_us") / (seconds * 1_000_000)))
    last = rows.groupBy(key, "_stretch").agg(F.max("_us").alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(key).orderBy("_stretch"))
    starts = last.select(F.col(key).alias("_of_key"), F.col("_stretch").alias("_of"), earlier.alias("_carried"))
    within = F.lag("_us").over(Window.partitionBy(key, "_stretch").orderBy("_us", order))
    own = rows.withColumn("_before", within)
    placed = own.join(starts, (F.col("_stretch") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_of_key")))
    return placed.select(key, order, (F.col("_us") - F.coalesce("_before", "_carried")).alias("us")).where("us is not null")


def epoch_means(log: DataFrame) -> DataFrame:
    """epoch, metric, n, mean."""
    return log.groupBy("epoch", "metric").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean"))


def due(counter: Column, every: int, offset: int = 0) -> Column:
    """Whether counter + offset is a multiple of every."""
    return F.pmod(counter + offset, F.lit(every)) == 0


def long_metrics(wide: DataFrame, key: str, pattern: str = "loss|grad|nwd") -> DataFrame:
    """key, metric, value of the columns whose names fit the pattern."""
    import re

    names = [c for c in wide.columns if c != key and re.search(pattern, c)]
    return wide.unpivot([key], names, "metric", "value")


def latest(files: DataFrame, kind: Column, iteration: Column) -> DataFrame:
    """kind, name: of each kind the file of the highest iteration."""
    return files.select(kind.alias("kind"), F.col("name"), iteration.alias("_at")).where("_at is not null").groupBy("kind").agg(F.max_by("name", "_at").alias("name"))


def report_rows(log: DataFrame, every: int) -> DataFrame:
    """iter, text of the report's sections: the logged iterations that are whole steps of every, each once."""
    due_ = log.where((F.col("iter") > 0) & due(F.col("iter"), every)).select(F.col("iter").cast("long").alias("iter"))
    return due_.distinct().select("iter", F.format_string("iteration [%d]", "iter").alias("text"))


def parts(files: DataFrame, part_bytes: int = 70_000_000) -> DataFrame:
    """name, part, start, size of the parts of files (name, size), the last one shorter."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / part_bytes)).cast("long")
    each = files.select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"))
    return each.select("name", "part", (F.col("part") * part_bytes).alias("start"), F.least(F.lit(part_bytes).cast("long"), F.col("size") - F.col("part") * part_bytes).alias("size"))
