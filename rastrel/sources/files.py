"""Datasets that are lists or folders of files. Paths are any that Spark reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """image, depth from a CSV file without a header."""
    return spark.read.schema("image string, depth string").csv(path, header=False)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """path of each line, without white space around it; empty lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def labelled_list(spark: SparkSession, path: str) -> DataFrame:
    """path, label (the first folder), class_id (the labels in order)."""
    rows = file_list(spark, path).withColumn("label", names.class_label(F.col("path")))
    labels = rows.select("label").distinct().withColumn("class_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))
    return rows.join(labels, "label").select("path", "label", "class_id")


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of the files; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.select("path", "length", "modificationTime")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path of every image under folder, sorted. ValueError if there is none."""
    found = scan(spark, folder).where(names.is_image(F.col("path"))).select("path").orderBy("path")
    if found.isEmpty():
        raise ValueError(f"no images under {folder}")
    return found


def tiffs(spark: SparkSession, folder: str, tiles_only: bool = False) -> DataFrame:
    """path of the TIFF files in folder, hidden ones left out, sorted; tiles_only: those named *_tile_*.tif."""
    path = F.col("path")
    found = scan(spark, folder, False).where(names.is_tiff(path) & ~names.hidden(path)).select("path")
    return (found.where(path.rlike(r"_tile_[^/]*\.tif$")) if tiles_only else found).orderBy("path")


def one_or_all(spark: SparkSession, folder: str, single: str | None = None) -> DataFrame:
    """The TIFF files of folder, or the one named. ValueError if it isn't there."""
    found = tiffs(spark, folder)
    if single is None:
        return found
    chosen = found.where(names.base_name(F.col("path")) == single)
    if chosen.isEmpty():
        raise ValueError(f"{single} is not in {folder}")
    return chosen


def unpacked(spark: SparkSession, folder: str) -> DataFrame:
    """archive, member, content: the TIFF members of files that are ZIP archives, and files that are TIFF themselves
    as they are (member null). What a file is, its first bytes tell."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                if content[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        rows = [(path, n, archive.read(n)) for n in sorted(archive.namelist()) if n.lower().endswith((".tif", ".tiff"))]
                elif content[:4] in (b"II*\x00", b"MM\x00*"):
                    rows = [(path, None, content)]
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(members, "archive string, member string, content binary")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
