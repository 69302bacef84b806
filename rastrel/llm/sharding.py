"""Contiguous shards of nearly equal bytes: global prefix sums of the documents' sizes, cut at equal targets.

A document's size is its UTF-8 bytes plus 1 (null text: 1). The documents are ordered by id, then checksum and size
(nulls first); the shard of a document is the one in whose share of all bytes its middle lies, so a shard is off its
target by less than one document. Rows with equal ids, checksums and sizes are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, prefixed

SHARDS = 16


def _sized(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *more)


def _cut(sized: DataFrame, shards: int) -> DataFrame:
    """sized (doc_id, size, text_crc32, ...) with shard and the gapless slot in it."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = prefixed(sized, order, "size", tag="shards")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor((2 * F.col("_before") + F.col("size")) * shards / 2 / F.col("_total"))).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first"))


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. The text itself is read once and never shuffled.

    Null texts count as empty (size 1, checksum 0), null ids come first, repeated rows each get a slot, an empty table
    gives no rows; other columns are ignored.
    """
    narrow = materialise(_sized(docs, id_col, text_col), "sizes")
    return _cut(narrow, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, and shard and slot (columns of these names are replaced). The texts move
    once, in the range shuffle that orders them. Null texts count as empty, null ids come first, repeated rows each get
    a slot, an empty table gives no rows."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = _sized(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"))
    return _cut(packed, shards).select(*[F.col("_doc").getField(c).alias(c) for c in kept], "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents under path/shard=N. Rows are already in shard order, so each task has few shards open. Odd
    rows as shard_documents() says; an empty table writes no shard."""
    shard_documents(docs, shards).write.partitionBy("shard").parquet(path)
