"""Missing values and masks. NaN is missing inside a raster; it is not null, and it equals itself here as in Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_where_missing(values: Column, mask: Column) -> Column:
    """values with 0 where mask is NaN: targets and predictions both take the target's mask."""
    return F.zip_with(values, mask, lambda v, m: F.when(F.isnan(m), 0.0).otherwise(v))


def n_missing(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: F.isnan(v))).cast("long")


def finite(values: Column, high: float = 3.4028234663852886e38) -> Column:
    """NaN becomes 0, infinities the largest magnitude."""
    return F.transform(values, lambda v: F.when(F.isnan(v), 0.0).when(v > high, high).when(v < -high, -high).otherwise(v))


def thresholded(target: Column, prediction: Column, low: float = 1.0, high: float = 30.0) -> Column:
    """The prediction, 0 where the target is at most low, and then where it is itself at least high."""
    cut = F.zip_with(target, prediction, lambda t, p: F.when(t <= low, 0.0).otherwise(p))
    return F.transform(cut, lambda p: F.when(p >= high, 0.0).otherwise(p))


def labelled_only(truth: Column, predicted: Column) -> Column:
    """The true class, 0 where nothing is predicted; 0 means unlabelled."""
    return F.when(predicted == 0, F.lit(0)).otherwise(truth)


def no_data(value: Column, sentinel: float = 0.0) -> Column:
    return F.nullif(value, F.lit(sentinel))
