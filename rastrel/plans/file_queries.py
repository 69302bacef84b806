"""Sources and sinks: what the given tables hold is written as files of each kind and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import names
from ..operators import focal
from ..sources import files, png, scratch, sinks, tiff
from .registry import ORACLE_SQL, TILES, query
from .table_queries import split_70_10_20

_SIDE = model.SIDE


def _number(path: str = "path") -> Column:
    """The number at the end of a file's stem."""
    return F.regexp_extract(path, r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("tile_id")


def _geotiffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile as an image of floats and a label of bytes, half a metre to a pixel, ten tiles to a line."""
    x0 = 500000.0 + F.pmod("tile_id", F.lit(10)) * 4.0
    y0 = 5400000.0 - F.floor(F.col("tile_id") / 10) * 4.0
    corner = {"x0": x0, "dx": F.lit(0.5), "rx": F.lit(0.0), "y0": y0, "ry": F.lit(0.0), "dy": F.lit(-0.5)}
    gt = F.struct(*[c.alias(n) for n, c in corner.items()])
    size = F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width")
    label = F.transform("v", lambda x: (x > 0).cast("double"))

    def of(kind: str, dtype: str, pixels: Column) -> DataFrame:
        name = F.format_string(f"{kind}/%04d.tif", "tile_id").alias("name")
        bands = F.array(pixels).alias("bands")
        crs = F.lit("EPSG:32632").alias("crs")
        return model.tiles(spark, sf_dir).select(name, *size, F.lit(dtype).alias("dtype"), gt.alias("gt"), crs, bands)

    return of("image", "f4", F.col("v")).union(of("label", "u1", label))


def _written(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch.folder(spark, "geotiff")
    tiff.write(_geotiffs(spark, sf_dir), folder)
    return folder


@query(
    f"""WITH {TILES}
    SELECT tile_id, i, v[i + 1] AS v, (v[i + 1] > 0)::BIGINT AS label
    FROM tiles, range(64) x(i)"""
)
def geotiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and labels, a GeoTIFF file each, read back and joined by the number in their names."""
    folder = _written(spark, sf_dir)
    of = lambda kind: tiff.read(spark, f"{folder}/{kind}").where("error is null")
    images = of("image").select(_number(), F.col("bands")[0].alias("v"))
    labels = of("label").select(_number(), F.col("bands")[0].alias("label"))
    both = images.join(labels, "tile_id").select("tile_id", F.posexplode(F.arrays_zip("v", "label")).alias("i", "x"))
    return both.select("tile_id", F.col("i").cast("long").alias("i"), "x.v", F.col("x.label").cast("long").alias("label"))


@query(
    """SELECT vec_id AS tile_id, kind, 8 AS width, 8 AS height, 1 AS n_bands, dtype,
        500000 + vec_id % 10 * 4.0::DOUBLE AS x0, 5400000 - vec_id // 10 * 4.0::DOUBLE AS y0,
        0.5::DOUBLE AS dx, -0.5::DOUBLE AS dy, 'EPSG:32632' AS crs
    FROM embeddings, (VALUES ('image', 'f4'), ('label', 'u1')) k(kind, dtype)"""
)
def geotiff_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, bands, type and place of GeoTIFF files, whose pixels are not decoded."""
    read = tiff.read(spark, f"{_written(spark, sf_dir)}/*", pixels=False).where("error is null")
    kind = F.regexp_extract("path", "([a-z]+)/[^/]*$", 1).alias("kind")
    return read.select(_number(), kind, "width", "height", "n_bands", "dtype", "gt.x0", "gt.y0", "gt.dx", "gt.dy", "crs")


def _tap(dr: int, dc: int) -> tuple[str, str]:
    """The value at a neighbour, 0 outside, and its weight."""
    r, c = f"(r0 + {dr})", f"(c0 + {dc})"
    value = f"CASE WHEN {r} BETWEEN 0 AND 7 AND {c} BETWEEN 0 AND 7 THEN v[{r} * 8 + {c} + 1] ELSE 0 END"
    return value, f"({'fy' if dr else '1 - fy'}) * ({'fx' if dc else '1 - fx'})"


_TAPS = [_tap(dr, dc) for dr in (0, 1) for dc in (0, 1)]


@query(
    f"""WITH {TILES},
    places AS (SELECT tile_id, list_transform(v, lambda x: greatest(0.0::DOUBLE, x)) AS v, i,
            (-0.73::DOUBLE - tile_id % 5 * 0.1::DOUBLE + (i % 12 + 0.5) * 0.4::DOUBLE) / 0.5 AS col,
            (0.53::DOUBLE - (i // 12 + 0.5) * 0.4::DOUBLE) / -0.5 AS row FROM tiles, range(144) x(i)),
    near AS (SELECT *, floor(row - 0.5)::BIGINT AS r0, floor(col - 0.5)::BIGINT AS c0 FROM places),
    parts AS (SELECT *, row - 0.5 - r0 AS fy, col - 0.5 - c0 AS fx FROM near),
    sums AS (SELECT tile_id, i, col >= 0 AND col <= 8 AND row >= 0 AND row <= 8 AS inside,
            {" + ".join(f"({v}) * {w}" for v, w in _TAPS)} AS total,
            {" + ".join(f"CASE WHEN ({v}) <> 0 THEN {w} ELSE 0 END" for v, w in _TAPS)} AS weight FROM parts)
    SELECT tile_id, i, round(CASE WHEN inside AND weight > 0 THEN total / weight ELSE 0 END, 6) AS v FROM sums"""
)
def warped_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles whose pixels at or below 0 are unknown, on a finer grid that begins beside them, as GeoTIFF files."""
    fixed = lambda **of: F.struct(*[F.lit(x).alias(n) if isinstance(x, float) else x.alias(n) for n, x in of.items()])
    gt = fixed(x0=0.0, dx=0.5, rx=0.0, y0=0.0, ry=0.0, dy=-0.5)
    to = fixed(x0=F.lit(-0.73) - F.pmod("tile_id", F.lit(5)) * 0.1, dx=0.4, rx=0.0, y0=0.53, ry=0.0, dy=-0.4)
    known = F.transform("v", lambda x: F.greatest(F.lit(0.0), x)).alias("v")
    tiles = model.tiles(spark, sf_dir).select("tile_id", known, gt.alias("gt"), to.alias("to"))
    # on its own, as a new column gt beside it would be taken for the old one inside the expression
    tiles = tiles.select("tile_id", "to", focal.warped(F.col("v"), F.col("gt"), _SIDE, _SIDE, F.col("to"), 12, 12).alias("made"))
    size = F.lit(12).alias("height"), F.lit(12).alias("width"), F.lit("f8").alias("dtype")
    name = F.format_string("%04d.tif", "tile_id").alias("name")
    folder = scratch.folder(spark, "warped")
    tiff.write(tiles.select(name, *size, F.col("to").alias("gt"), F.lit("EPSG:32632").alias("crs"), F.array("made").alias("bands")), folder)
    flat = tiff.read(spark, folder).where("error is null").select(_number(), F.posexplode(F.col("bands")[0]).alias("i", "v"))
    return flat.select("tile_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


_RGB = """bytes AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x:
        least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor((x + 1) * 127.5)))::BIGINT) AS v FROM embeddings)"""


def _greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("v", lambda x: F.floor((x + 1) * 127.5).cast("double"))
    size = F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width")
    return model.tiles(spark, sf_dir).select("tile_id", *size, grey.alias("v"))


@query(
    f"""WITH {_RGB}
    SELECT a.vec_id AS tile_id, i, a.v[i + 1] AS red, b.v[i + 1] AS green, c.v[i + 1] AS blue
    FROM bytes a JOIN bytes b ON b.vec_id = a.vec_id + 1 JOIN bytes c ON c.vec_id = a.vec_id + 2, range(64) x(i)"""
)
def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiles in a row as the bands of a PNG file, decoded by the image source."""
    grey = _greys(spark, sf_dir)
    band = lambda k: grey.select((F.col("tile_id") - k).alias("tile_id"), F.col("v").alias(f"v{k}"))
    rows = grey.select("tile_id", "height", "width").join(band(0), "tile_id").join(band(1), "tile_id").join(band(2), "tile_id")
    name = F.format_string("%04d.png", "tile_id").alias("name")
    folder = scratch.folder(spark, "png")
    sinks.files(png.encoded(rows.select(name, "height", "width", F.array("v0", "v1", "v2").alias("bands"))), folder)
    flat = tiff.read_images(spark, folder).select(_number(), F.posexplode(F.arrays_zip(*[F.col("bands")[k].alias(c) for k, c in enumerate(("red", "green", "blue"))])).alias("i", "x"))
    values = [F.col(f"x.{c}").cast("long").alias(c) for c in ("red", "green", "blue")]
    return flat.select("tile_id", F.col("i").cast("long").alias("i"), *values)


@query(
    f"""WITH {_RGB}, placed AS (SELECT vec_id // 16 AS sheet, v,
            row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS k FROM bytes),
        sizes AS (SELECT sheet, count(*) AS n FROM placed GROUP BY sheet),
        canvas AS (SELECT sheet, least(n, 8) AS columns, (n + least(n, 8) - 1) // least(n, 8) AS lines FROM sizes),
        places AS (SELECT sheet, columns, 2 + columns * 10 AS width, (2 + lines * 10) * (2 + columns * 10) AS n FROM canvas),
        pixels AS (SELECT sheet, columns, i, i // width - 2 AS r, i % width - 2 AS c
            FROM (SELECT *, unnest(range(n)) AS i FROM places))
    SELECT p.sheet, p.i, coalesce(t.v[p.r % 10 * 8 + p.c % 10 + 1], 0) AS v FROM pixels p LEFT JOIN placed t
        ON t.sheet = p.sheet AND p.r >= 0 AND p.c >= 0 AND p.r % 10 < 8 AND p.c % 10 < 8
            AND t.k = p.r // 10 * p.columns + p.c // 10"""
)
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of sixteen tiles, eight to a line, as PNG files, read back."""
    tiles = _greys(spark, sf_dir).select("tile_id", "height", "width", F.array("v").alias("bands"))
    folder = scratch.folder(spark, "sheets")
    sinks.files(png.sheets(tiles, "tile_id", 8, 16), folder)
    flat = tiff.read_images(spark, folder).select(_number().alias("sheet"), F.posexplode(F.col("bands")[0]).alias("i", "v"))
    return flat.select("sheet", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


@query(
    """SELECT format('image/{:04d}_{}.png', p_partkey, p_brand) AS image, format('depth/{:04d}, {}.png', p_partkey, p_type) AS depth FROM part"""
)
def pair_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an image and its heights, written as lists without a header and read back."""
    path = scratch.folder(spark, "pairs")
    image = F.format_string("image/%04d_%s.png", "p_partkey", "p_brand")
    depth = F.format_string("depth/%04d, %s.png", "p_partkey", "p_type")
    model.table(spark, sf_dir, "part").select(image.alias("image"), depth.alias("depth")).write.csv(path, header=False)
    return files.pair_list(spark, path)


@query(f"""WITH split AS ({ORACLE_SQL["split_70_10_20"]}) SELECT split, printf('%04d', o_orderkey) AS id FROM split""")
def split_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids for each split, read back split by split."""
    path = scratch.folder(spark, "manifests")
    sinks.manifests(split_70_10_20(spark, sf_dir), path, "o_orderkey")
    found = None
    for split in ("train", "validation", "test", "rest"):
        if files.exists(spark, f"{path}/split={split}"):
            ids = files.file_list(spark, f"{path}/split={split}").select(F.lit(split).alias("split"), F.col("path").alias("id"))
            found = ids if found is None else found.union(ids)
    return spark.createDataFrame([], "split string, id string") if found is None else found


#: What the files of the folder queries are called: an ending for each remainder of the key.
_ENDINGS = ("jpg", "PNG", "txt", "tif", "TIFF", "bmp", "json")
_NAMES = f"""names AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'deep/er/' ELSE '' END AS place,
    CASE WHEN s_suppkey % 5 = 0 THEN '.' ELSE '' END || 'x_tile_' || s_suppkey || '.' ||
    (CASE s_suppkey % 7 {' '.join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDINGS))} END) AS base FROM supplier)"""


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file per supplier, a third of them deeper, a fifth hidden."""
    key = F.col("s_suppkey")
    place = F.when(key % 3 == 0, "deep/er/").otherwise("")
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (key % 7 + 1).cast("int"))
    name = F.concat(place, F.when(key % 5 == 0, ".").otherwise(""), F.lit("x_tile_"), key.cast("string"), F.lit("."), ending)
    folder = scratch.folder(spark, "folder")
    content = F.encode(key.cast("string"), "UTF-8")
    sinks.files(model.table(spark, sf_dir, "supplier").select(name.alias("name"), content.alias("content")), folder)
    return folder


@query(
    f"""WITH {_NAMES}, base AS (SELECT k, place, base FROM names WHERE NOT starts_with(base, '.'))
    SELECT 'image' AS kind, base AS name FROM base WHERE k % 7 IN (0, 1, 5)
    UNION ALL SELECT 'tiff', base FROM base WHERE place = '' AND k % 7 IN (3, 4)
    UNION ALL SELECT 'tile', base FROM base WHERE place = '' AND k % 7 = 3
    UNION ALL SELECT 'single', base FROM base WHERE base = (SELECT min(base) FROM base WHERE place = '' AND k % 7 IN (3, 4))"""
)
def folder_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images under a folder at any depth, its TIFF files, its tiles, and one file chosen by its name."""
    folder = _folder(spark, sf_dir)
    tiffs = files.tiffs(spark, folder)
    single = tiffs.select(F.min(names.base_name(F.col("path")))).first()[0]
    found = {"image": files.images(spark, folder), "tiff": tiffs, "tile": files.tiffs(spark, folder, True), "single": files.one_or_all(spark, folder, single)}
    out = None
    for kind, rows in found.items():
        rows = rows.select(F.lit(kind).alias("kind"), names.base_name(F.col("path")).alias("name"))
        out = rows if out is None else out.union(rows)
    return out


_MAGIC = b"II*\x00"


def _boxed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files of name, content: of even names ZIP archives with a TIFF member and a note, of others the content itself."""
    for frame in frames:
        made = []
        for name, content in zip(frame["name"], frame["content"], strict=True):
            if int(name.partition(".")[0]) % 2 == 0:
                with zipfile.ZipFile(box := io.BytesIO(), "w") as archive:
                    archive.writestr("note.txt", "a note")
                    archive.writestr("scene.TIF", content)
                content = box.getvalue()
            made.append(content)
        yield pd.DataFrame({"name": frame["name"], "content": made})


@query(
    r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'scene.TIF' END AS member,
        sha256('\x49\x49\x2A\x00'::BLOB || encode(coalesce(html, ''))) AS digest FROM pages"""
)
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads that are rasters or archives of them, told by their first bytes and unpacked."""
    content = F.concat(F.lit(_MAGIC), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")))
    pages = model.table(spark, sf_dir, "pages").select(F.format_string("%d.download", "page_id").alias("name"), content.alias("content"))
    folder = scratch.folder(spark, "downloads")
    sinks.files(pages.mapInPandas(_boxed, "name string, content binary"), folder)
    name = F.regexp_extract("archive", r"([0-9]+)\.download$", 1).cast("long")
    return files.unpacked(spark, folder).select(name.alias("page_id"), "member", F.sha2("content", 256).alias("digest"))
