"""Per-pixel transforms and changes of shape, inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import mean, places, total

#: Principal components of natural image colours, and their strengths.
EIGENVALUES = (0.2175, 0.0188, 0.0045)
EIGENVECTORS = ((-0.5675, 0.7192, 0.4009), (-0.5808, -0.0045, -0.8140), (-0.5836, -0.6948, 0.4203))
#: Luma weights of red, green, blue.
LUMA = (0.299, 0.587, 0.114)
#: Channel means and deviations of natural images.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def flip_rows(v: Column, height: int, width: int) -> Column:
    return places(height, width, lambda r, c: F.get(v, (height - 1 - r) * width + c))


def flip_cols(v: Column, height: int, width: int) -> Column:
    return places(height, width, lambda r, c: F.get(v, r * width + (width - 1 - c)))


def quarter_turns(v: Column, turns: int, height: int, width: int) -> Column:
    """Counter-clockwise by quarter turns."""
    turns %= 4
    if turns == 0:
        return v
    if turns == 2:
        return F.reverse(v)
    if turns == 1:
        return places(width, height, lambda r, c: F.get(v, c * width + (width - 1 - r)))
    return places(width, height, lambda r, c: F.get(v, (height - 1 - c) * width + r))


def crop(v: Column, row0: int, col0: int, height: int, width: int, full_width: int) -> Column:
    return places(height, width, lambda r, c: F.get(v, (r + row0) * full_width + c + col0))


def centre_crop(v: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """The start is half of what is left over, halves to the even number."""
    return crop(v, round((height - new_height) / 2), round((width - new_width) / 2), new_height, new_width, width)


def shorter_edge(height: Column, width: Column, size: int) -> tuple[Column, Column]:
    """Height and width after the shorter edge is brought to size, fractions cut off; unchanged if it is size."""
    wide = width >= height
    same = F.least(height, width) == size
    other = lambda a, b: F.floor(F.lit(size) * a / b).cast("int")
    return F.when(same, height).when(wide, F.lit(size)).otherwise(other(height, width)), F.when(same, width).when(wide, other(width, height)).otherwise(F.lit(size))


def nearest(v: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    return places(new_height, new_width, lambda r, c: F.get(v, F.floor((r + 0.5) * (height / new_height)).cast("int") * width + F.floor((c + 0.5) * (width / new_width)).cast("int")))


def normalise(v: Column, mean_: float, deviation: float) -> Column:
    return F.transform(v, lambda x: (x - mean_) / deviation)


def grey(red: Column, green: Column, blue: Column) -> Column:
    return F.zip_with(F.zip_with(red, green, lambda r, g: LUMA[0] * r + LUMA[1] * g), blue, lambda s, b: s + LUMA[2] * b)


def towards(v: Column, other: Column, share: Column | float) -> Column:
    """v + (other - v) share, pixel by pixel: saturation towards grey, brightness towards 0."""
    return F.zip_with(v, other, lambda x, y: x + (y - x) * share)


def contrast(v: Column, grey_: Column, share: Column | float) -> Column:
    """Towards the mean of the grey tile."""
    middle = mean(grey_)
    return F.element_at(F.transform(F.array(middle), lambda m: F.transform(v, lambda x: x + (m - x) * share)), 1)


def lighting(v: Column, band: int, alphas: Sequence[Column]) -> Column:
    """The band plus its part of the colour components, each times its draw."""
    add = F.lit(0.0)
    for k, alpha in enumerate(alphas):
        add = add + EIGENVECTORS[band][k] * alpha * EIGENVALUES[k]
    return F.transform(v, lambda x: x + add)


def to_u8(value: Column, high: float = 3000.0) -> Column:
    """value / high, kept within 0 and 1, times 255, fractions cut off."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / high)) * 255).cast("int")


def vegetation(nir: Column, red: Column) -> Column:
    return (nir - red) / (nir + red + 1e-6)


def made_up_blue(green: Column, index: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), green * (1 - index * 0.3)))


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Kept within low and high, then brought to 0..1; a flat range gives 0."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(F.least(high, F.greatest(low, x)) - low, high - low), F.lit(0.0)))


def softmax(v: Column) -> Column:
    powers = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.element_at(F.transform(F.array(F.struct(powers.alias("e"), total(powers).alias("s"))), lambda z: F.transform(z["e"], lambda x: x / z["s"])), 1)


def length(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def slerp(a: Column, b: Column, share: Column | float) -> Column:
    """Along the arc between two vectors, by the angle between their directions; on a line if they are parallel."""
    dot = F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), length(a) * length(b))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))

    def between(w: Column) -> Column:
        flat = F.abs(F.sin(w)) < 1e-12
        u = F.when(flat, 1.0 - F.lit(share)).otherwise(F.try_divide(F.sin((1.0 - F.lit(share)) * w), F.sin(w)))
        v = F.when(flat, F.lit(share)).otherwise(F.try_divide(F.sin(F.lit(share) * w), F.sin(w)))
        return F.element_at(F.transform(F.array(F.struct(u.alias("u"), v.alias("v"))), lambda k: F.zip_with(a, b, lambda x, y: x * k["u"] + y * k["v"])), 1)

    return F.element_at(F.transform(F.array(angle), between), 1)
