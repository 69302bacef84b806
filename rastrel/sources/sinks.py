"""What is written: tiles, split manifests, logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(rows: DataFrame, path: str) -> None:
    """Tile rows as Parquet, a folder per raster. Rows of a raster are brought together first, so that a raster has
    few files; a raster with many is split by the rebalance."""
    rows.hint("rebalance", "raster_id").write.partitionBy("raster_id").parquet(path)


def manifests(splits: DataFrame, path: str, key: str = "tile_id") -> None:
    """split=<name>/ text files of ids of at least four digits."""
    splits.select("split", F.format_string("%04d", key).alias("value")).write.partitionBy("split").text(path)


def logs(rows: DataFrame, path: str, *by: str) -> None:
    """A JSON object per row, in a folder for each value of by, if given: the copies of a log by trial, say."""
    (rows.write.partitionBy(*by) if by else rows.write).json(path)


def texts(rows: DataFrame, path: str, pattern: str, *columns: str) -> None:
    """A line per row, the columns put into a printf pattern."""
    rows.select(F.format_string(pattern, *columns).alias("value")).write.text(path)


def split_bytes(files: DataFrame, part_bytes: int = 70_000_000) -> DataFrame:
    """name, part, n_parts, content of files (name, content): pieces of part_bytes, the last one shorter. Null content
    counts as empty, and an empty file is one empty part."""
    whole = F.coalesce("content", F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(whole) / part_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(whole, k * part_bytes + 1, F.lit(part_bytes)))
    return files.select("name", n.alias("n_parts"), F.posexplode(cut).alias("part", "content")).select("name", "part", "n_parts", "content")


def rejoined(parts: DataFrame) -> DataFrame:
    """name, n_parts, content of parts as split_bytes() makes them, in any order. Content is null where a part is
    missing or is there twice."""
    held = parts.groupBy("name").agg(F.max("n_parts").alias("n_parts"), F.sort_array(F.collect_list(F.struct("part", "content"))).alias("_p"))
    whole = F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["content"])), ""))
    complete = F.transform("_p", lambda p: p["part"]) == F.sequence(F.lit(0), F.col("n_parts") - 1)
    return held.select("name", "n_parts", F.when(complete, whole).alias("content"))


def files(rows: DataFrame, folder: str) -> int:
    """Writes a file folder/name for each of rows (name, content) into a folder that every executor reaches, and returns
    how many. Names may hold folders. A file appears under its name when it is whole, so that a task can be run again."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        named = "://" in folder or folder.startswith("file:")
        store, root = fs.FileSystem.from_uri(folder) if named else (fs.LocalFileSystem(), folder)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                place = f"{root}/{name}".rpartition("/")[0]
                store.create_dir(place, recursive=True)
                draft = f"{place}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(content)
                target = f"{root}/{name}"
                if store.get_file_info(target).type != fs.FileType.NotFound:  # an earlier attempt's; not all stores replace
                    store.delete_file(target)
                store.move(draft, target)
            yield pd.DataFrame({"n": [len(frame)]})

    written = rows.select("name", "content").mapInPandas(put, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
