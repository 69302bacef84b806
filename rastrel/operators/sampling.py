"""Splits, shuffles, batches and seeds. Chance comes from MD5 of a seed and the row's own key, so that a run can be
repeated anywhere; the rows it picks are not those of another generator, only the shares are.

Exact sizes need ranks. Ranks over all rows are dealt by hash prefix: each bucket ranks its own rows
and starts where the buckets before it end, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key, uniform


#: Rows that a bucket holds on average at most.
BUCKET_ROWS = 4_000_000


def shuffled_rank(rows: DataFrame, seed: object, *keys: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with rank, from 0, in the order of their hashes, and n_rows; both within by, if given, where null is a
    group of its own. The number of buckets follows from the number of rows."""
    digits, n = 2, rows.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    hashed = rows.withColumn("_h", key(seed, *[F.col(k) for k in keys]))
    bucketed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    sizes = bucketed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_b").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in by],
        F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*by)).alias("n_rows"),
    )
    same = F.col("_b") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *keys)) - 1
    # without by there are 16^digits starts at most; with it, their number is that of the groups
    placed = bucketed.withColumn("_own", own).join(starts if by else F.broadcast(starts), same)
    rank = (F.col("_start") + F.col("_own")).cast("long")
    return placed.withColumn("rank", rank).drop("_h", "_b", "_own", "_start", *[c for c in starts.columns if c.startswith("_of")])


def split(rows: DataFrame, seed: object, key_col: str, parts: Sequence[tuple[str, int]] = (("train", 7), ("validation", 1), ("test", 2))) -> DataFrame:
    """key, split: each part has its tenths of the rows, fractions cut off; what is left over has split 'rest'."""
    ranked = shuffled_rank(rows.select(key_col), seed, key_col)
    out, low = F.lit("rest"), F.lit(0)
    cuts = []
    for name, tenths in parts:
        high = low + F.floor(F.col("n_rows") / 10 * tenths)
        cuts.append((name, low, high))
        low = high
    for name, a, b in reversed(cuts):
        out = F.when((F.col("rank") >= a) & (F.col("rank") < b), name).otherwise(out)
    return ranked.select(key_col, out.alias("split"))


def stratified(rows: DataFrame, seed: object, key_col: str, class_col: str, share: float, repeats: int = 1) -> DataFrame:
    """key, class, repeat, split: of every class share of the rows, rounded down but at least one, is 'train', the rest
    'test'; each repeat, from 0, has a seed of its own. A class is ranked in buckets, so none needs one task."""
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))
    each = rows.select(key_col, class_col, F.explode(numbers).alias("repeat"))
    own_seed = F.concat(F.lit(f"{seed}-"), F.col("repeat").cast("string"))
    ranked = shuffled_rank(each, own_seed, key_col, by=("repeat", class_col))
    taken = F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("n_rows") * share))
    return ranked.select(key_col, class_col, "repeat", F.when(taken, "train").otherwise("test").alias("split"))


def batches(rows: DataFrame, seed: object, size: int, key_col: str, drop_last: bool = True) -> DataFrame:
    """key, batch_id in shuffled order; a last batch that is not full goes."""
    ranked = shuffled_rank(rows.select(key_col), seed, key_col).withColumn("batch_id", F.floor(F.col("rank") / size).cast("long"))
    if drop_last:
        ranked = ranked.where((F.col("batch_id") + 1) * size <= F.col("n_rows"))
    return ranked.select(key_col, "batch_id")


def trial_seeds(names: DataFrame, trials: int, seed: object = 0) -> DataFrame:
    """name, trial, seed in [0, 2^32) for every name and trial."""
    many = names.select("name", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    return many.select("name", F.col("trial").cast("long").alias("trial"), F.conv(F.substring(key(seed, F.col("name"), F.col("trial")), 1, 8), 16, 10).cast("long").alias("seed"))


def random_window(seed: object, key_col: Column, height: int, width: int, size: int) -> tuple[Column, Column, Column]:
    """row0 and col0 of a random crop, and whether to flip it."""
    pick = lambda tag, room: F.floor(uniform(f"{seed}{tag}", key_col) * (room + 1)).cast("long")
    return pick("r", height - size), pick("c", width - size), uniform(f"{seed}f", key_col) < 0.5


def shuffled_steps(seed: object, steps: Sequence[str], *keys: Column) -> Column:
    """The steps in an order drawn for the row."""
    drawn = F.array_sort(F.array(*[F.struct(key(seed, *keys, F.lit(s)).alias("k"), F.lit(s).alias("step")) for s in steps]))
    return F.transform(drawn, lambda s: s["step"])
