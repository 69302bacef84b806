"""Errors between a target and a prediction.

The per-tile forms take the tiles' pixel arrays and stay inside the row. What is averaged over tiles is averaged
after the per-tile value is finished: a mean of root mean squares is not the root of the mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mean, paired, total


def mse(t: Column, p: Column) -> Column:
    return mean(paired(t, p, lambda x, y: (x - y) * (x - y)))


def rmse(t: Column, p: Column) -> Column:
    return F.sqrt(mse(t, p))


def mae(t: Column, p: Column) -> Column:
    return mean(paired(t, p, lambda x, y: F.abs(x - y)))


def relative(x: Column, y: Column) -> Column:
    """Mean of |y - x| / (y + 1); a pixel at y = -1 makes it null."""
    ratios = paired(x, y, lambda a, b: F.try_divide(F.abs(b - a), F.abs(b + 1)))
    return F.when(F.exists(ratios, lambda r: r.isNull()), F.lit(None).cast("double")).otherwise(mean(ratios))


def psnr(error: Column, peak: float = 1.0) -> Column:
    """From a mean squared error; null without an error."""
    return F.when(error > 0, 10 * F.log10(F.lit(peak * peak) / error))


def log_l1(t: Column, p: Column, offset: float = 0.5) -> Column:
    return mean(paired(t, p, lambda x, y: F.ln(F.abs(x - y) + offset)))


def _centred(v: Column) -> Column:
    middle = mean(v)
    return F.element_at(F.transform(F.array(middle), lambda m: F.transform(v, lambda x: x - m)), 1)


def zncc(t: Column, p: Column) -> Column:
    """Sum of products over the root of the product of the sums of squares, both centred; 0 for a flat tile."""
    def of(a: Column, b: Column) -> Column:
        norm = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
        return F.when(norm < 1e-10, 0.0).otherwise(F.try_divide(total(paired(a, b, lambda x, y: x * y)), norm))

    return F.element_at(F.transform(F.array(F.struct(_centred(t).alias("a"), _centred(p).alias("b"))), lambda s: of(s["a"], s["b"])), 1)


def zncc_sample(t: Column, p: Column) -> Column:
    """The mean of products of values standardised with the sample deviation: zncc times (n - 1) / n."""
    n = F.size(t)
    return zncc(t, p) * (n - 1) / n


def per_tile(pairs: DataFrame) -> DataFrame:
    """pairs (tile_id, site, t, p) with mse, mae, rmse, zncc and zncc_sample."""
    return pairs.select("tile_id", "site", mse(F.col("t"), F.col("p")).alias("mse"), mae(F.col("t"), F.col("p")).alias("mae"), zncc(F.col("t"), F.col("p")).alias("zncc"), F.size("t").alias("n")).select(
        "tile_id", "site", "mse", "mae", F.sqrt("mse").alias("rmse"), "zncc", (F.col("zncc") * (F.col("n") - 1) / F.col("n")).alias("zncc_sample")
    )


def by_site(values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Mean and sample deviation of each metric by site; a site of one tile has a null deviation."""
    out = []
    for name in names:
        out += [F.round(F.avg(name), 9).alias(f"{name}_mean"), F.round(F.try_divide(F.stddev_samp(name), F.lit(1.0)), 9).alias(f"{name}_std")]
    return values.groupBy("site").agg(F.count(F.lit(1)).alias("n_tiles"), *out)


def batch_errors(pairs: DataFrame, batch: int) -> DataFrame:
    """Per batch of consecutive tiles the summed errors over pixels per image, and their averages weighted by batch
    size up to then: total over images, root at the end."""
    rows = pairs.select(F.floor(F.col("tile_id") / batch).cast("long").alias("batch_id"), F.size("t").alias("hw"), total(paired("t", "p", lambda x, y: (x - y) * (x - y))).alias("se"), total(paired("t", "p", lambda x, y: F.abs(x - y))).alias("ae"))
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("se") / F.max("hw") / F.count(F.lit(1))).alias("mse"), (F.sum("ae") / F.max("hw") / F.count(F.lit(1))).alias("mae"))


def weighted(batches: DataFrame) -> DataFrame:
    """One row: mse, mae, rmse over all batches (n, mse, mae), weighted by n; the root is taken last."""
    out = batches.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("mse") * F.col("n")), F.sum("n")).alias("mse"), F.try_divide(F.sum(F.col("mae") * F.col("n")), F.sum("n")).alias("mae"))
    return out.select("n", F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"), F.round(F.sqrt("mse"), 9).alias("rmse"))


def ssim(t: Column, p: Column, height: int, width: int, window: int = 7, span: float = 1.0) -> Column:
    """Mean structural similarity over all whole windows of window x window, uniform weights, sample covariance."""
    c1, c2, n = (0.01 * span) ** 2, (0.03 * span) ** 2, window * window

    def index(s: Column) -> Column:
        ux, uy = s["x"] / n, s["y"] / n
        fix = n / (n - 1)
        vx, vy, vxy = fix * (s["xx"] / n - ux * ux), fix * (s["yy"] / n - uy * uy), fix * (s["xy"] / n - ux * uy)
        return ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))

    corners = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - window)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - window)), lambda c: F.struct(r.alias("r"), c.alias("c")))))

    def sums(k: Column) -> Column:
        rows = F.sequence(F.lit(0), F.lit(window - 1))
        cut = lambda v: F.flatten(F.transform(rows, lambda d: F.slice(v, (k["r"] + d) * width + k["c"] + 1, F.lit(window))))
        a, b = cut(t), cut(p)
        both = lambda f: total(F.zip_with(a, b, f))
        return F.struct(total(a).alias("x"), total(b).alias("y"), both(lambda x, y: x * x).alias("xx"), both(lambda x, y: y * y).alias("yy"), both(lambda x, y: x * y).alias("xy"))

    return mean(F.transform(F.transform(corners, sums), index))
