"""Grids, georeferences, focal operators and pixel transforms over the stand-in tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import geo, rng
from ..operators import augment, focal, grid, masks, sampling, transforms
from .registry import PAIRS, TILES, fractal, query

_SIDE = model.SIDE


def _flat(rows: DataFrame, **arrays: Column) -> DataFrame:
    """tile_id, i and the arrays' values rounded to 9 places, a row per pixel."""
    zipped = rows.select("tile_id", F.posexplode(F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])).alias("i", "x"))
    return zipped.select("tile_id", F.col("i").cast("long").alias("i"), *[F.round(F.col(f"x.{n}"), 9).alias(n) for n in arrays])


_CELLS = TILES + ", g AS (SELECT tile_id, v, i, i // 8 AS r, i % 8 AS c FROM tiles, range(64) x(i))"


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster_id, height, width and a geotransform: a part's key and size stand in."""
    part = model.table(spark, sf_dir, "part")
    gt = F.struct(F.lit(500000.0).alias("x0"), F.lit(0.5).alias("dx"), F.lit(0.0).alias("rx"), F.lit(5400000.0).alias("y0"), F.lit(0.0).alias("ry"), F.lit(-0.5).alias("dy"))
    return part.select(F.col("p_partkey").alias("raster_id"), (F.col("p_size") * 20 + 100).alias("height"), (F.pmod(F.col("p_partkey"), F.lit(1000)) + 60).cast("int").alias("width"), gt.alias("gt"))


_RASTERS = "rasters AS (SELECT p_partkey AS raster_id, p_size * 20 + 100 AS height, (p_partkey % 1000 + 60)::INTEGER AS width FROM part)"
_STARTS = """starts AS (SELECT raster_id, height, width, (height - 1) // 256 + 1 AS nr, (width - 1) // 256 + 1 AS nc, greatest(height - 256, 0) AS hr, greatest(width - 256, 0) AS hc FROM rasters),
    steps AS (SELECT *, CASE WHEN nr > 1 THEN hr // (nr - 1) ELSE 256 END AS sr, CASE WHEN nc > 1 THEN hc // (nc - 1) ELSE 256 END AS sc FROM starts),
    cells AS (SELECT raster_id, (i * nc + j)::BIGINT AS tile_idx, least(i * sr, hr)::BIGINT AS row0, least(j * sc, hc)::BIGINT AS col0 FROM (SELECT *, unnest(range(nc)) AS j FROM (SELECT *, unnest(range(nr)) AS i FROM steps)))"""


@query(f"WITH {_RASTERS}, {_STARTS} SELECT * FROM cells")
def overlap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.overlap_grid(_rasters(spark, sf_dir), 256)


@query(f"WITH {_RASTERS}, {_STARTS} SELECT raster_id, tile_idx, 500000.0::DOUBLE + col0 * 0.5::DOUBLE + row0 * 0.0::DOUBLE AS x0, 5400000.0::DOUBLE + col0 * 0.0::DOUBLE + row0 * -0.5::DOUBLE AS y0 FROM cells")
def geotransform_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rasters = _rasters(spark, sf_dir)
    return grid.georeferenced(grid.overlap_grid(rasters, 256), rasters).select("raster_id", "tile_idx", "gt.x0", "gt.y0")


@query(f"""WITH {_RASTERS} SELECT raster_id, i AS it, j AS jt, i * 500 AS x0, j * 500 AS y0, 'tile_' || i || '_' || j AS name
    FROM (SELECT raster_id, i, unnest(range(ceil(height / 500)::BIGINT)) AS j FROM (SELECT raster_id, height, unnest(range(ceil(width / 500)::BIGINT)) AS i FROM rasters))""")
def nonoverlap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.plain_grid(_rasters(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster_id and bounds in metres: a supplier's key and balance stand in."""
    s = model.table(spark, sf_dir, "supplier")
    x, y = F.pmod(F.col("s_suppkey") * 37, F.lit(900)).cast("double"), F.pmod(F.col("s_suppkey") * 91, F.lit(700)).cast("double")
    return s.select(F.col("s_suppkey").alias("raster_id"), x.alias("xmin"), y.alias("ymin"), (x + 250).alias("xmax"), (y + 180).alias("ymax"))


_BOXES = "boxes AS (SELECT s_suppkey AS raster_id, (s_suppkey * 37 % 900)::DOUBLE AS xmin, (s_suppkey * 91 % 700)::DOUBLE AS ymin, (s_suppkey * 37 % 900)::DOUBLE + 250 AS xmax, (s_suppkey * 91 % 700)::DOUBLE + 180 AS ymax FROM supplier)"


@query(f"""WITH {_BOXES}, o AS (SELECT *, floor(xmin / 80) * 80 AS ox, floor(ymin / 80) * 80 AS oy FROM boxes),
    n AS (SELECT *, ceil((xmax - ox) / 80)::BIGINT AS nx, ceil((ymax - oy) / 80)::BIGINT AS ny FROM o),
    c AS (SELECT *, ox + ix * 80 AS x0, oy + iy * 80 AS y0 FROM (SELECT *, unnest(range(ny)) AS iy FROM (SELECT *, unnest(range(nx)) AS ix FROM n)))
    SELECT raster_id, ix, iy, x0, y0, x0 + 100 AS x1, y0 + 100 AS y1, format('tile_{{:04d}}_{{:04d}}', ix, iy) AS name FROM c WHERE NOT (x0 >= xmax OR y0 >= ymax OR x0 + 100 <= xmin OR y0 + 100 <= ymin)""")
def metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.metric_grid(_boxes(spark, sf_dir), 100.0, 20.0)


@query(f"WITH {_BOXES} SELECT raster_id, (xmin + xmax) / 2 - 50 AS x0, (ymin + ymax) / 2 - 50 AS y0, (xmin + xmax) / 2 + 50 AS x1, (ymin + ymax) / 2 + 50 AS y1 FROM boxes")
def single_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.centred_tile(_boxes(spark, sf_dir), 100.0)


@query(f"WITH {_BOXES} SELECT raster_id, unnest(range(5)) AS k, unnest([xmin, xmax, xmax, xmin, xmin]) AS x, unnest([ymin, ymin, ymax, ymax, ymin]) AS y FROM boxes")
def footprint_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = geo.ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return _boxes(spark, sf_dir).select("raster_id", F.posexplode(ring).alias("k", "p")).select("raster_id", F.col("k").cast("long").alias("k"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return model.table(spark, sf_dir, "customer").select(key.alias("place_id"), (F.pmod(key * 7, F.lit(3601)) / 10.0 - 180).alias("lon"), (F.pmod(key * 13, F.lit(1601)) / 10.0 - 80).alias("lat"))


@query("""WITH p AS (SELECT c_custkey AS place_id, (c_custkey * 7 % 3601) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 13 % 1601) / 10.0::DOUBLE - 80 AS lat FROM customer)
    SELECT place_id, least(60, floor((lon + 180) / 6)::INTEGER + 1) AS zone, format('EPSG:{:d}{:02d}', CASE WHEN lat >= 0 THEN 326 ELSE 327 END, least(60, floor((lon + 180) / 6)::INTEGER + 1)) AS epsg FROM p""")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("place_id", geo.utm_zone(F.col("lon")).alias("zone"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def _utm_sql() -> str:
    """The third-order Krueger series both ways, with the projection's constants worked out."""
    radius, alpha, beta = geo.series()
    e = geo.ECCENTRICITY
    terms = lambda cs, f, g, a, b: " + ".join(f"{c!r}::DOUBLE * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, c in enumerate(cs, 1))
    latitude = "chi"
    for _ in range(4):
        latitude = f"asin(tanh(atanh(sin(chi)) + {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin({latitude}))))"
    return f"""WITH p AS (SELECT c_custkey AS place_id, (c_custkey * 7 % 3601) / 10.0::DOUBLE - 180 AS lon,
            (c_custkey * 13 % 1601) / 10.0::DOUBLE - 80 AS lat FROM customer),
        z AS (SELECT *, least(60, floor((lon + 180) / 6)::INTEGER + 1) AS zone, lat < 0 AS south FROM p),
        k AS (SELECT place_id, zone, south, radians(lon + dx - (zone * 6 - 183)) AS lam,
                radians(CASE WHEN south THEN least(lat + dy, -1e-9::DOUBLE) ELSE greatest(lat + dy, 0.0::DOUBLE) END) AS phi
            FROM z, (VALUES (-0.25::DOUBLE), (0.25::DOUBLE)) a(dx), (VALUES (-0.25::DOUBLE), (0.25::DOUBLE)) b(dy)),
        t AS (SELECT *, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t FROM k),
        x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
        m AS (SELECT place_id, zone, south,
                500000 + {geo.SCALE * radius!r}::DOUBLE * (eta + {terms(alpha, "cos", "sinh", "xi", "eta")}) AS x,
                CASE WHEN phi < 0 THEN 10000000.0::DOUBLE ELSE 0 END
                    + {geo.SCALE * radius!r}::DOUBLE * (xi + {terms(alpha, "sin", "cosh", "xi", "eta")}) AS y FROM x),
        box AS (SELECT place_id, zone, south, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
            FROM m GROUP BY place_id, zone, south),
        u AS (SELECT *, (ymin - CASE WHEN south THEN 10000000.0::DOUBLE ELSE 0 END) / {geo.SCALE * radius!r}::DOUBLE AS xi,
                (xmin - 500000) / {geo.SCALE * radius!r}::DOUBLE AS eta FROM box),
        w AS (SELECT *, xi - ({terms(beta, "sin", "cosh", "xi", "eta")}) AS wx, eta - ({terms(beta, "cos", "sinh", "xi", "eta")}) AS wy FROM u),
        c AS (SELECT *, asin(sin(wx) / cosh(wy)) AS chi FROM w)
        SELECT place_id, zone, round(xmin, 2) AS xmin, round(ymin, 2) AS ymin, round(xmax, 2) AS xmax, round(ymax, 2) AS ymax,
            round(degrees(atan2(sinh(wy), cos(wx))) + (zone * 6 - 183), 6) AS lon, round(degrees({latitude}), 6) AS lat FROM c"""


@query(_utm_sql())
def utm_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place's box of half a degree in metres of its zone, from the four corners, to the centimetre, and the way
    back. A box that crosses the equator stops there."""
    zone = geo.utm_zone(F.col("lon"))
    corners = F.array(*[F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat")) for dx in (-0.25, 0.25) for dy in (-0.25, 0.25)])
    rows = _places(spark, sf_dir).select("place_id", zone.alias("zone"), corners.alias("corners"), (F.col("lat") < 0).alias("south"))

    def metre(k: Column) -> Column:
        x, y = geo.to_utm(k["lon"], F.when(F.col("south"), F.least(k["lat"], F.lit(-1e-9))).otherwise(F.greatest(k["lat"], F.lit(0.0))), F.col("zone"))
        return F.struct(x.alias("x"), y.alias("y"))

    rows = rows.select("place_id", "zone", "south", F.transform("corners", metre).alias("m"))
    low, high = (lambda c: F.array_min(F.col(f"m.{c}"))), (lambda c: F.array_max(F.col(f"m.{c}")))
    rows = rows.select("place_id", "zone", "south", low("x").alias("xmin"), low("y").alias("ymin"), high("x").alias("xmax"), high("y").alias("ymax"))
    lon, lat = geo.from_utm(F.col("xmin"), F.col("ymin"), F.col("zone"), F.col("south"))
    metres = [F.round(c, 2).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return rows.select("place_id", "zone", *metres, F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""WITH {_CELLS} SELECT tile_id, i, round(v[(7 - r) * 8 + c + 1], 9) AS upside_down, round(v[r * 8 + (7 - c) + 1], 9) AS mirrored, round(v[c * 8 + (7 - r) + 1], 9) AS quarter, round(v[63 - i + 1], 9) AS half, round(v[(7 - c) * 8 + r + 1], 9) AS three_quarters FROM g""")
def flip_rotate_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _flat(model.tiles(spark, sf_dir), upside_down=transforms.flip_rows(v, 8, 8), mirrored=transforms.flip_cols(v, 8, 8), quarter=transforms.quarter_turns(v, 1, 8, 8), half=transforms.quarter_turns(v, 2, 8, 8), three_quarters=transforms.quarter_turns(v, 3, 8, 8))


@query(f"""WITH {TILES} SELECT tile_id, i, round(v[(i // 5 + 2) * 8 + i % 5 + 2 + 1], 9) AS crop, round(v[floor((i // 5 + 0.5) * (8 / 5.0::DOUBLE))::BIGINT * 8 + floor((i % 5 + 0.5) * (8 / 5.0::DOUBLE))::BIGINT + 1], 9) AS near FROM tiles, range(25) x(i)""")
def center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(model.tiles(spark, sf_dir), crop=transforms.centre_crop(F.col("v"), 8, 8, 5, 5), near=transforms.nearest(F.col("v"), 8, 8, 5, 5))


@query(f"""WITH {TILES} SELECT tile_id, i, round((v[i + 1] - 0.485) / 0.229, 9) AS red, round(v[i + 1] / 255.0::DOUBLE, 9) AS scaled, round((v[i + 1] + 1) / 2, 9) AS shown FROM tiles, range(64) x(i)""")
def channel_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _flat(model.tiles(spark, sf_dir), red=transforms.normalise(v, transforms.MEANS[0], transforms.DEVIATIONS[0]), scaled=transforms.normalise(v, 0.0, 255.0), shown=transforms.normalise(v, -1.0, 2.0))


_DRAW = "('0x' || substr(md5('crop{0}|' || tile_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""WITH {TILES}, u AS (SELECT tile_id, v, floor({_DRAW.format('r')} * 4)::BIGINT AS r, floor({_DRAW.format('c')} * 4)::BIGINT AS c,
                 {_DRAW.format('f')} < 0.5 AS f FROM tiles)
    SELECT tile_id, i, round(v[(r + i // 5) * 8 + c + CASE WHEN f THEN 4 - i % 5 ELSE i % 5 END + 1], 9) AS v FROM u, range(25) x(i)""")
def random_crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of a random crop of 5 by 5, every other one mirrored."""
    row, col, flip = sampling.random_window("crop", F.col("tile_id"), 8, 8, 5)
    cut = model.tiles(spark, sf_dir).select("tile_id", grid.cut(F.col("v"), row, col, 5, F.lit(8)).alias("v"), flip.alias("f"))
    return _flat(cut, v=F.when(F.col("f"), transforms.flip_cols(F.col("v"), 5, 5)).otherwise(F.col("v")))


_BANDS = TILES + ", rgb AS (SELECT a.tile_id, a.v AS red, b.v AS green, c.v AS blue FROM tiles a JOIN tiles b ON b.tile_id = a.tile_id + 1 JOIN tiles c ON c.tile_id = a.tile_id + 2)"


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiles in a row as the bands of an image."""
    every = model.tiles(spark, sf_dir)
    band = lambda k, name: every.select((F.col("tile_id") - k).alias("tile_id"), F.col("v").alias(name))
    return band(0, "red").join(band(1, "green"), "tile_id").join(band(2, "blue"), "tile_id")


@query(f"WITH {_BANDS} SELECT tile_id, i, round(0.299 * red[i + 1] + 0.587 * green[i + 1] + 0.114 * blue[i + 1], 9) AS grey FROM rgb, range(64) x(i)")
def grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_rgb(spark, sf_dir), grey=transforms.grey(F.col("red"), F.col("green"), F.col("blue")))


@query(f"""WITH {_BANDS}, g AS (SELECT tile_id, red, list_transform(range(1, 65), lambda i: 0.299 * red[i] + 0.587 * green[i] + 0.114 * blue[i]) AS grey FROM rgb), m AS (SELECT *, list_reduce(list_concat([0.0::DOUBLE], grey), lambda a, b: a + b) / 64 AS m FROM g)
    SELECT tile_id, i, round(red[i + 1] + (grey[i + 1] - red[i + 1]) * 0.4, 9) AS saturation, round(red[i + 1] + (0 - red[i + 1]) * 0.3, 9) AS brightness, round(red[i + 1] + (m - red[i + 1]) * 0.2, 9) AS contrast FROM m, range(64) x(i)""")
def color_jitter_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = F.col("red")
    rows = _rgb(spark, sf_dir).select("tile_id", "red", transforms.grey(red, F.col("green"), F.col("blue")).alias("grey"))
    black = F.transform("red", lambda x: F.lit(0.0))
    return _flat(rows, saturation=transforms.towards(red, F.col("grey"), 0.4), brightness=transforms.towards(red, black, 0.3), contrast=transforms.contrast(red, F.col("grey"), 0.2))


@query(f"""WITH {_BANDS}, a AS (SELECT *, list_transform([0, 1, 2], lambda k: (('0x' || substr(md5('light|' || tile_id || '|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5) * 0.2) AS a FROM rgb)
    SELECT tile_id, i, round(red[i + 1] + (-0.5675 * a[1] * 0.2175 + 0.7192 * a[2] * 0.0188 + 0.4009 * a[3] * 0.0045), 9) AS red, round(green[i + 1] + (-0.5808 * a[1] * 0.2175 + -0.0045 * a[2] * 0.0188 + -0.8140 * a[3] * 0.0045), 9) AS green,
           round(blue[i + 1] + (-0.5836 * a[1] * 0.2175 + -0.6948 * a[2] * 0.0188 + 0.4203 * a[3] * 0.0045), 9) AS blue FROM a, range(64) x(i)""")
def lighting_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = [(rng.uniform("light", F.col("tile_id"), F.lit(k)) - 0.5) * 0.2 for k in range(3)]
    rows = _rgb(spark, sf_dir).select("*", *[d.alias(f"a{k}") for k, d in enumerate(draws)])
    alphas = [F.col(f"a{k}") for k in range(3)]
    return _flat(rows, **{name: transforms.lighting(F.col(name), k, alphas) for k, name in enumerate(("red", "green", "blue"))})


@query(f"""WITH {_BANDS}, s AS (SELECT tile_id, i, (red[i + 1] + 1) / 2 AS nir, (green[i + 1] + 1) / 2 AS red, (blue[i + 1] + 1) / 2 AS green FROM rgb, range(64) x(i)), n AS (SELECT *, (nir - red) / (nir + red + 1e-6) AS vi FROM s)
    SELECT tile_id, i, round(vi, 9) AS vi, round(least(1.0, greatest(0.0, green * (1 - vi * 0.3))), 9) AS blue FROM n""")
def vegetation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda c: F.transform(c, lambda x: (x + 1) / 2)
    rows = _rgb(spark, sf_dir).select("tile_id", half("red").alias("nir"), half("green").alias("red"), half("blue").alias("green"))
    index = F.zip_with("nir", "red", transforms.vegetation)
    return _flat(rows.select("tile_id", "green", index.alias("vi")), vi=F.col("vi"), blue=F.zip_with("green", "vi", transforms.made_up_blue))


def _edge(row: str, col: str) -> str:
    return f"v[greatest(0, least(7, {row})) * 8 + greatest(0, least(7, {col})) + 1]"


@query(f"""WITH {_CELLS}, d AS (SELECT tile_id, i, ({_edge('r + 1', 'c')} - {_edge('r - 1', 'c')}) / CASE WHEN r IN (0, 7) THEN 1.0 ELSE 2.0 END AS dy, ({_edge('r', 'c + 1')} - {_edge('r', 'c - 1')}) / CASE WHEN c IN (0, 7) THEN 1.0 ELSE 2.0 END AS dx FROM g),
    n AS (SELECT tile_id, i, -1.5 * dx AS nx, 1.5 * dy AS ny FROM d)
    SELECT tile_id, i, round(greatest(0.0, (nx * (cos(radians(-225.0)) * cos(radians(45.0))) + ny * (sin(radians(-225.0)) * cos(radians(45.0))) + sin(radians(45.0))) / sqrt(nx * nx + ny * ny + 1)), 9) AS shade FROM n""")
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(model.tiles(spark, sf_dir), shade=focal.hillshade(F.col("v"), _SIDE, _SIDE))


@query(f"""WITH {TILES}, g AS (SELECT tile_id, v, i, greatest(0.0::DOUBLE, (i // 12 + 0.5) * (8 / 12.0::DOUBLE) - 0.5) AS y, greatest(0.0::DOUBLE, (i % 12 + 0.5) * (8 / 12.0::DOUBLE) - 0.5) AS x FROM tiles, range(144) t(i)),
    f AS (SELECT *, floor(y)::BIGINT AS r, floor(x)::BIGINT AS c, y - floor(y) AS fy, x - floor(x) AS fx FROM g)
    SELECT tile_id, i, round(({_edge('r', 'c')} * (1 - fx) + {_edge('r', 'c + 1')} * fx) * (1 - fy) + ({_edge('r + 1', 'c')} * (1 - fx) + {_edge('r + 1', 'c + 1')} * fx) * fy, 9) AS v FROM f""")
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(model.tiles(spark, sf_dir), v=focal.bilinear(F.col("v"), 8, 8, 12, 12))


@query(f"""WITH {TILES} SELECT tile_id, i, round(v[(i // 16) // 2 * 8 + (i % 16) // 2 + 1], 9) AS v FROM tiles, range(256) x(i)""")
def nearest_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(model.tiles(spark, sf_dir), v=focal.enlarge(F.col("v"), 2, 8, 8))


_KERNEL = ((0.0, 0.25, 0.0), (0.125, 0.5, 0.0), (0.0, 0.0, 0.125))


@query(f"""WITH {_CELLS}
    SELECT tile_id, i, round(CASE WHEN r + 1 <= 7 THEN v[(r + 1) * 8 + c + 1] ELSE 0 END * 0.25 + CASE WHEN c + 1 <= 7 THEN v[r * 8 + c + 2] ELSE 0 END * 0.125 + v[r * 8 + c + 1] * 0.5 + CASE WHEN r >= 1 AND c >= 1 THEN v[(r - 1) * 8 + c] ELSE 0 END * 0.125, 9) AS v FROM g""")
def psf_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(model.tiles(spark, sf_dir), v=focal.convolve(F.col("v"), _KERNEL, _SIDE, _SIDE))


@query(f"""WITH {PAIRS}, l AS (SELECT tile_id, t, p, sqrt(list_reduce(list_transform(t, lambda x: x * x), lambda a, b: a + b)) AS lt, sqrt(list_reduce(list_transform(p, lambda x: x * x), lambda a, b: a + b)) AS lp,
               list_reduce(list_transform(range(1, 65), lambda i: t[i] * p[i]), lambda a, b: a + b) AS dot FROM pairs),
    w AS (SELECT *, acos(least(1.0, greatest(-1.0, dot / (lt * lp)))) AS w FROM l)
    SELECT tile_id, i, round(t[i + 1] * (sin(0.7 * w) / sin(w)) + p[i + 1] * (sin(0.3 * w) / sin(w)), 9) AS v FROM w, range(64) x(i)""")
def slerp_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(model.pairs(spark, sf_dir), v=transforms.slerp(F.col("t"), F.col("p"), 0.3))


@query("""SELECT p_partkey AS raster_id, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_retailprice * 2 / 3000.0::DOUBLE)) * 255)::INTEGER AS u8, nullif(p_size::DOUBLE, 1.0) AS height FROM part""")
def reflectance_scale_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("raster_id"), transforms.to_u8(F.col("p_retailprice") * 2).alias("u8"), masks.no_data(F.col("p_size").cast("double"), 1.0).alias("height"))


@query("""WITH r AS (SELECT p_partkey AS raster_id, p_size AS w, p_size * 2 + p_partkey % 50 AS h FROM part)
    SELECT raster_id, CASE WHEN least(h, w) = 40 THEN h WHEN w >= h THEN 40 ELSE 40 * h // w END::BIGINT AS h, CASE WHEN least(h, w) = 40 THEN w WHEN w >= h THEN 40 * w // h ELSE 40 END::BIGINT AS w FROM r""")
def shorter_edge_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("raster_id"), F.col("p_size").alias("w"), (F.col("p_size") * 2 + F.pmod(F.col("p_partkey"), F.lit(50))).alias("h"))
    h, w = transforms.shorter_edge(F.col("h"), F.col("w"), 40)
    return rows.select("raster_id", h.cast("long").alias("h"), w.cast("long").alias("w"))


_UNIFORM = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""WITH {TILES}, n AS (SELECT tile_id, i, (v[i + 1] + 1) * 127.5 + 12 * (sqrt(-2 * ln(1 - {_UNIFORM.format("'noisea|' || tile_id || '|' || i")})) * cos(6.283185307179586 * ({_UNIFORM.format("'noiseb|' || tile_id || '|' || i")}))) AS x FROM tiles, range(64) x(i))
    SELECT tile_id, i, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, x)))::BIGINT AS v FROM n""")
def gaussian_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("v", lambda x: (x + 1) * 127.5)
    rows = model.tiles(spark, sf_dir).select("tile_id", F.posexplode(augment.noisy(grey, 12.0, "noise", F.col("tile_id"))).alias("i", "v"))
    return rows.select("tile_id", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


@query(f"""WITH s AS (SELECT event_id AS k, event_id // 100 AS path, value / 100 * cos(event_id % 63 / 10.0::DOUBLE) AS re, value / 100 * sin(event_id % 63 / 10.0::DOUBLE) AS im FROM events)
    SELECT k, path, round(re, 9) AS re, round(im, 9) AS im, round(sum(round(re, 6)::DECIMAL(18, 6)) OVER w, 6)::DOUBLE AS x, round(sum(round(im, 6)::DECIMAL(18, 6)) OVER w, 6)::DOUBLE AS y,
           (sum(CASE WHEN im < 0 THEN 1 ELSE 0 END) OVER w % 2)::BIGINT AS turned FROM s WINDOW w AS (PARTITION BY path ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def blur_path_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places along paths of polar steps, and whether an odd number of steps so far pointed down."""
    from pyspark.sql import Window

    angle = F.pmod("event_id", F.lit(63)) / 10.0
    steps = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.floor(F.col("event_id") / 100).alias("path"), (F.col("value") / 100 * F.cos(angle)).alias("re"), (F.col("value") / 100 * F.sin(angle)).alias("im"))
    so_far = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    place = lambda c: F.sum(F.round(c, 6).cast("decimal(18,6)")).over(so_far).cast("double")
    return steps.select("k", "path", F.round("re", 9).alias("re"), F.round("im", 9).alias("im"), place("re").alias("x"), place("im").alias("y"), F.pmod(F.sum(F.when(F.col("im") < 0, 1).otherwise(0)).over(so_far), F.lit(2)).cast("long").alias("turned"))


@query(
    f"""WITH {fractal(2.0)},
    lit AS (SELECT tile_id, f, list_transform(v, lambda x: (x + 1) * 127.5 / 255.0) AS v FROM fractal JOIN tiles USING (tile_id)),
    top AS (SELECT *, list_max(v) AS t FROM lit)
    SELECT tile_id, i, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v[i + 1] + 1.5 * f[i + 1]) * t / (t + 1.5))) * 255, 9) AS v
    FROM top, range(64) x(i)"""
)
def plasma_fog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles under a fog of their own."""
    tiles = model.tiles(spark, sf_dir).select("tile_id", F.transform("v", lambda x: (x + 1) * 127.5).alias("v"))
    maps = augment.per_batch(tiles, lambda ids, _: augment.plasma(8, 2.0, augment.draws(ids, 64)), 8, 8).withColumnRenamed("v", "fractal")
    return _flat(tiles.join(maps, "tile_id"), v=augment.fogged(F.col("v"), F.col("fractal"), 1.5))


def _bspline(d: str) -> str:
    """The quadratic B-spline at d."""
    return f"CASE WHEN abs({d}) <= 0.5 THEN 0.75 - {d} * {d} WHEN abs({d}) <= 1.5 THEN 0.5 * (1.5 - abs({d})) * (1.5 - abs({d})) ELSE 0.0 END"


@query(
    f"""WITH {TILES},
    turned AS (SELECT tile_id, v, i, radians((tile_id % 90)::DOUBLE) AS t, i // 8 - 3.5::DOUBLE AS y, i % 8 - 3.5::DOUBLE AS x
        FROM tiles, range(64) p(i)),
    source AS (SELECT tile_id, v, i, cos(t) * y + sin(t) * x + 3.5 AS sy, -sin(t) * y + cos(t) * x + 3.5 AS sx FROM turned),
    near AS (SELECT *, round_even(sy, 0)::BIGINT + dr AS r, round_even(sx, 0)::BIGINT + dc AS c
        FROM source, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)),
    taps AS (SELECT *, ({_bspline("(sy - r)")}) * ({_bspline("(sx - c)")}) AS w FROM near)
    SELECT tile_id, i, round(sum(CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 THEN w * v[r * 8 + c + 1] ELSE 0 END) / sum(w), 9) AS v
    FROM taps GROUP BY tile_id, i"""
)
def rotate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile turned by its number of degrees, modulo 90."""
    return _flat(augment.per_batch(model.tiles(spark, sf_dir), lambda ids, t: augment.rotated(t, ids % 90), 8, 8), v=F.col("v"))


@query()
def motion_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernels = lambda ids: np.stack([augment.motion_kernel(np.random.default_rng(i), 0.3) for i in ids])
    return augment.per_batch(model.tiles(spark, sf_dir), lambda ids, t: augment.convolve(t, kernels(ids)), 8, 8)


#: Kernels of resampling at the place named x: cubic reaches over 2 places, lanczos over 3.
_KERNELS = {
    "cubic": (2, "CASE WHEN abs(x) < 1 THEN 1.5 * abs(x) ** 3 - 2.5 * x * x + 1 ELSE -0.5 * abs(x) ** 3 + 2.5 * x * x - 4 * abs(x) + 2 END"),
    "lanczos": (3, "CASE WHEN x = 0 THEN 1.0 ELSE sin(pi() * x) / (pi() * x) * (sin(pi() * x / 3) / (pi() * x / 3)) END"),
}


def _weights(name: str, n: int, m: int, how: str) -> str:
    """A common table o, k, w: what place k of n adds to place o of m."""
    reach, kernel = _KERNELS[how]
    wide = max(1.0, n / m)
    return f"""{name} AS (SELECT o, k, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, k, {kernel} AS w
        FROM (SELECT o, k, (k - ((o + 0.5::DOUBLE) * {n} / {m} - 0.5)) / {wide}::DOUBLE AS x FROM range({m}) a(o), range({n}) b(k))
        WHERE abs(x) < {reach}))"""


def _resampled(name: str, source: str, rows: str, columns: str) -> str:
    """A common table tile_id, r, c, v: the table source with its rows and columns weighted."""
    return f"""{name}_rows AS (SELECT tile_id, o AS r, c, sum(w * v) AS v FROM {source}, {rows} WHERE k = r GROUP BY tile_id, o, c),
    {name} AS (SELECT tile_id, r, o AS c, sum(w * v) AS v FROM {name}_rows, {columns} WHERE k = c GROUP BY tile_id, r, o)"""


_PIXELS = f"{TILES}, px AS (SELECT tile_id, i // 8 AS r, i % 8 AS c, v[i + 1] AS v FROM tiles, range(64) p(i))"


@query(
    f"""WITH {_PIXELS}, {_weights("fewer", 8, 4, "cubic")}, {_weights("more", 4, 8, "cubic")},
    {_resampled("down", "px", "fewer", "fewer")}, {_resampled("up", "down", "more", "more")}
    SELECT tile_id, r * 8 + c AS i, round(v, 9) AS v FROM up"""
)
def cubic_down_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles made smaller by half and brought back."""
    return _flat(augment.per_batch(model.tiles(spark, sf_dir), lambda _, t: augment.down_and_up(t, 0.5), 8, 8), v=F.col("v"))


@query(
    f"""WITH {_PIXELS}, {_weights("tall", 8, 12, "lanczos")}, {_weights("wide", 8, 10, "lanczos")}, {_resampled("made", "px", "tall", "wide")}
    SELECT tile_id, r * 10 + c AS i, round(v, 9) AS v FROM made"""
)
def lanczos_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles brought to 12 rows and 10 columns."""
    return _flat(augment.per_batch(model.tiles(spark, sf_dir), lambda _, t: augment.resample(t, 12, 10), 8, 8), v=F.col("v"))
