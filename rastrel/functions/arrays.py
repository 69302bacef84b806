"""Sums and positions over arrays, inside the row: no shuffle, and always in the same order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def paired(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def places(height: int, width: int, f: Callable[[Column, Column], Column]) -> Column:
    """An array of f(row, column), row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: f(F.floor(i / width).cast("int"), i % width))


def at(values: Column, row: Column, col: Column, height: int, width: int, outside: float | None = 0.0) -> Column:
    """The value at a place; outside of the tile: a number, or the nearest edge's value (None)."""
    if outside is None:
        row, col = F.greatest(F.lit(0), F.least(F.lit(height - 1), row)), F.greatest(F.lit(0), F.least(F.lit(width - 1), col))
        return F.get(values, row * width + col)
    inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
    return F.when(inside, F.get(values, row * width + col)).otherwise(F.lit(outside))
