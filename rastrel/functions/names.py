"""Identity that is kept in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The endings that an image folder scan accepts, in any case.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "ppm", "bmp")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last ending; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]*)$", 1))


def is_image(path: Column) -> Column:
    return ending(path).isin(*IMAGE_ENDINGS)


def is_tiff(path: Column) -> Column:
    return F.lower(path).rlike(r"\.tiff?$")


def hidden(path: Column) -> Column:
    return base_name(path).startswith(".")


def zero_filled(text: Column, width: int) -> Column:
    """Zeros in front up to width; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def slice_name(path: Column, prefix: str, token: int = 4, width: int = 4) -> Column:
    """prefix, then the numbered token of the underscored stem with zeros in front, then the ending."""
    return F.concat(F.lit(prefix), zero_filled(F.get(F.split(stem(path), "_"), F.lit(token)), width), F.lit("."), ending(path))


def natural_key(text: Column) -> Column:
    """Sorts runs of digits by value: each is given 20 digits."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), zero_filled(p, 20)).otherwise(p)), "")


def iteration(path: Column) -> Column:
    """The 8 digits before a 3-letter ending."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit(r"([0-9]{8})\.[a-z]{2,3}$")), F.lit(1)).cast("long")


def compact_exponent(value: Column) -> Column:
    """Scientific with three decimals and without plus sign or leading zeros in the exponent."""
    return F.regexp_replace(F.format_string("%.3e", value), r"e([+-])0*([0-9])", "e$1$2").alias("text")


def class_label(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.lit(0))
