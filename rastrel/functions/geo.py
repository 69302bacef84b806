"""Geotransforms, UTM zones and the transverse Mercator projection as expressions.

A geotransform is the struct x0, dx, rx, y0, ry, dy: a pixel's place is x0 + col dx + row rx, y0 + col ry + row dy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _FLAT, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
ECCENTRICITY = 2 * math.sqrt(_FLAT / (2 - _FLAT)) / (1 + _FLAT / (2 - _FLAT))


def place(gt: Column, row: Column, col: Column) -> tuple[Column, Column]:
    return gt["x0"] + col * gt["dx"] + row * gt["rx"], gt["y0"] + col * gt["ry"] + row * gt["dy"]


def shifted(gt: Column, row: Column, col: Column) -> Column:
    """The geotransform of the window that starts at row, col."""
    x, y = place(gt, row, col)
    return F.struct(x.alias("x0"), gt["dx"].alias("dx"), gt["rx"].alias("rx"), y.alias("y0"), gt["ry"].alias("ry"), gt["dy"].alias("dy"))


def utm_zone(lon: Column) -> Column:
    """1 to 60; longitude 180 belongs to zone 60."""
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """326zz on the northern half, the equator included, else 327zz."""
    return F.format_string("EPSG:%d%02d", F.when(lat >= 0, 326).otherwise(327), utm_zone(lon))


def ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A closed ring of five places."""
    return F.array(*[F.array(x, y) for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))])


def series() -> tuple[float, list[float], list[float]]:
    """The radius of the rectifying sphere, and the coefficients towards the plane and back."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forward, inverse


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the third-order Krueger series (within a millimetre in a zone)."""
    radius, alpha, _ = series()
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east += a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north += a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + SCALE * radius * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + SCALE * radius * north


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude, the inverse of to_utm."""
    radius, _, beta = series()
    xi = (north - F.when(south, 10000000.0).otherwise(0.0)) / (SCALE * radius)
    eta = (east - 500000) / (SCALE * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x -= b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y -= b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for _ in range(4):  # the isometric latitude, undone by fixed-point steps
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi))))
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183), F.degrees(phi)
