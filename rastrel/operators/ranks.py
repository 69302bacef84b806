"""Exact quantiles of groups of any size.

A percentile aggregate holds all different values of a group in one task. That is right for groups that fit there, and
their sizes are counted first. Beyond that the ranks asked for are closed in on: every round counts a group's values in
4096 equal bins, which needs a count per bin only, and goes on with the few bins that hold a rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
ROUNDS = 2
#: Rows of a group that one task may hold, and rows that may be broadcast.
MOST_ROWS, MOST_BROADCAST = 5_000_000, 500_000


def quantiles(
    rows: DataFrame, value: str, shares: Mapping[str, float], *keys: str, also: Sequence[Column] = (), most: int = MOST_ROWS
) -> DataFrame:
    """keys, n, a column for each name of shares, and the aggregates of also, by keys. Between two ranks values are
    interpolated. n counts rows; nulls have no rank, NaN comes last, and a group without values has null quantiles.
    Null keys are a group. The results do not depend on most; no rows give none."""
    sizes = rows.groupBy(*keys).count().agg(F.max("count"), F.count(F.lit(1))).first()
    widest, n_groups = sizes[0] or 0, sizes[1]
    if widest <= most:
        each = [F.percentile(value, F.lit(q)).alias(name) for name, q in shares.items()]
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *each, *also)
    return _selected(rows, value, shares, keys, also, n_groups * 2 * len(shares) <= MOST_BROADCAST)


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return out


def _renamed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        parts = parts.withColumnRenamed(k, f"_of_{k}")
    return parts


def _within(values: DataFrame, parts: DataFrame, keys: Sequence[str], send: bool) -> DataFrame:
    """Each value with the part (_lo to _hi, _start) of its group that it falls in; the others go."""
    sides = _renamed(parts.drop("_ranks"), keys)
    fits = _same(keys) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return values.join(F.broadcast(sides) if send else sides, fits).select(*values.columns, "_lo", "_hi", "_start")


def _holding(cells: DataFrame, parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The cells (_c values each) that hold ranks asked for, with these and with the rank _at of their first value."""
    window = Window.partitionBy(*keys, "_start").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_c").over(window), F.lit(0)))
    asked = _renamed(parts.select(*keys, F.col("_start").alias("_from"), "_ranks"), keys)
    both = placed.join(asked, _same(keys) & (F.col("_start") == F.col("_from")))
    ranks = F.filter("_ranks", lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_c")))
    return both.withColumn("_ranks", ranks).where(F.size("_ranks") > 0)


def _selected(
    rows: DataFrame, value: str, shares: Mapping[str, float], keys: Sequence[str], also: Sequence[Column], send: bool
) -> DataFrame:
    v = F.col(value).cast("double")
    values = rows.select(*keys, v.alias("_v")).where("_v is not null")
    spans = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), *also
    )
    place = {name: (F.col("_n") - 1) * F.lit(q) for name, q in shares.items()}
    ranks = F.array_distinct(F.array(*[f(p) for p in place.values() for f in (F.floor, F.ceil)]))
    parts = spans.where("_n > 0").select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_start"), ranks.alias("_ranks"))
    width = F.col("_hi") - F.col("_lo")
    scaled = F.floor((F.col("_v") - F.col("_lo")) / width * BINS)
    # a span that is no finite number stays whole for the round
    cell = F.when((width > 0) & (width < float("inf")), F.least(F.lit(BINS - 1), scaled)).otherwise(F.lit(0))
    for _ in range(ROUNDS):
        held = _within(values, parts, keys, send).withColumn("_cell", cell.cast("int"))
        counts = held.groupBy(*keys, "_start", "_cell").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        parts = _holding(counts, parts, keys, "_cell").select(*keys, "_lo", "_hi", F.col("_at").alias("_start"), "_ranks")
    counts = _within(values, parts, keys, send).groupBy(*keys, "_start", "_v").agg(F.count(F.lit(1)).alias("_c"))
    hits = _holding(counts, parts, keys, "_v").select(*keys, F.explode("_ranks").alias("_rank"), "_v")
    found = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_found"))
    out = spans.join(_renamed(found, keys), _same(keys), "left")

    def between(p: Column) -> Column:
        low, high = F.floor(p), F.ceil(p)
        a, b = F.try_element_at("_found", low), F.try_element_at("_found", high)
        return F.when(low == high, a).otherwise((high - p) * a + (p - low) * b)

    extra = [c for c in spans.columns if c not in (*keys, "n", "_n", "_lo", "_hi")]
    return out.select(*keys, "n", *[between(p).alias(name) for name, p in place.items()], *extra)
