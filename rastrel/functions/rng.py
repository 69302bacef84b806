"""Uniform numbers from MD5: the same in every run, on every cluster, and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: object, *parts: Column) -> Column:
    """32 hex digits from the seed (a value or a column) and the parts."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first, *[p.cast("string") for p in parts]).cast("binary"))


def uniform(seed: object, *parts: Column) -> Column:
    """In [0, 1), from the first 8 hex digits."""
    return F.conv(F.substring(key(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: object, *parts: Column) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    u, v = uniform(f"{seed}a", *parts), uniform(f"{seed}b", *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(6.283185307179586 * v)
