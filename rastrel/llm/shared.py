"""What the corpus operators share: the cluster's shared folder, Arrow batches of bounded size, global prefix sums."""

from __future__ import annotations

import importlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

cloudpickle.register_pickle_by_value(importlib.import_module(__package__))  # tasks need not find the package

#: Text bytes that one numpy pass works on; a longer document is a pass of its own.
PIECE_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker at most; Spark's own setting is no larger by default.
BATCH_BYTES = 64 << 20

_own: dict[str, str] = {}
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one temporary folder per application, which only a
    local master can use (ValueError for others)."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if not (conf.get("spark.master") or "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="rastrel-"))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, never handed out twice."""
    path = f"{shared_root(spark)}/rastrel/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is made inside is deleted at the end, but for the tables from materialise() that keep() was called with."""
    mark, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    yield keep
    made = _written[mark:]
    del _written[mark:]
    _delete(spark, [path for path in made if path not in kept])
    _written.extend(path for path in made if path in kept)


def drop(df: DataFrame) -> None:
    """Deletes a table from materialise(); others, such as input tables, are left alone."""
    if (path := getattr(df, "stored_at", None)) in _written:
        _written.remove(path)
        _delete(df.sparkSession, [path])


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what materialise() and shared_path() have made; call it when the results have been read."""
    _delete(spark, _written)
    _written.clear()


def _bytes(text: str) -> int:
    """What a size setting such as 64m says."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", text.lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, so that a Python worker's memory follows neither the number nor the
    length of the documents. The bound is a session setting; only one above BATCH_BYTES, or none, is lowered."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(df.sparkSession.conf.get(key)) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(f, schema)


def same(a: Column, b: Column) -> Column:
    """Equality under which nulls equal each other."""
    return a.eqNullSafe(b)


def small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """df marked for broadcast if its counted rows (narrow ones) are few enough; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's bytes in each stay under most, but for single longer rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_buffer(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to


def text_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, without copying, and the n + 1 offsets into them (null: empty)."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    kind, step = (np.int64, 8) if wide else (np.int32, 4)
    ends = np.frombuffer(offsets, dtype=kind, count=len(values) + 1, offset=values.offset * step).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def prefixed(df: DataFrame, order: Sequence[Column], value: str, group: str | None = None, modulus: int | None = None, tag: str = "prefix") -> DataFrame:
    """Adds ``_before`` (sum of value over the earlier rows of the row's group, modulo modulus if given), ``_row``
    (count of those rows), ``_total`` and ``_rows`` (of the whole group).

    One range shuffle by the order, which must start with the group; each partition sums its own rows in one pass,
    and the totals, a row per partition and group that meets it, give every partition its offset. No task sees more
    than its partition, however large a group is.
    """
    wide = StructType([*df.schema.fields]).add("_part", IntegerType()).add("_sum", LongType()).add("_count", LongType())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, total, count = TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            if group is None:
                heads, keys = np.zeros(1, np.int64), [None]
            else:
                runs = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
                codes = np.where(np.asarray(runs.is_null()), -1, np.asarray(runs.indices.fill_null(0)))
                heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                keys = [None if codes[h] < 0 else runs.dictionary[int(codes[h])].as_py() for h in heads]
            sums, counts = np.empty(n, np.int64), np.empty(n, np.int64)
            for k, (head, end) in enumerate(zip(heads, [*heads[1:], n], strict=True)):
                if (keys[k],) != last:
                    last, total, count = (keys[k],), 0, 0
                run = np.cumsum(values[head:end])
                sums[head:end] = total + run - values[head:end]
                counts[head:end] = count + np.arange(end - head)
                total, count = total + int(run[-1]), count + int(end - head)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(sums), pa.array(counts)], names=[*batch.schema.names, "_part", "_sum", "_count"])

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(map_batches(ranged, local, wide), tag)
    keys = ["_part"] if group is None else ["_part", group]
    of_part = rows.groupBy(*keys).agg(F.max(F.col("_sum") + F.col(value)).alias("_ps"), F.max(F.col("_count") + 1).alias("_pc"))
    if modulus:
        of_part = of_part.withColumn("_ps", F.pmod("_ps", F.lit(modulus)))
    whole = Window.partitionBy(*keys[1:])
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(of_part.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_ps").over(earlier), F.lit(0)).alias("_os"), F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_oc"),
        F.sum("_ps").over(whole).alias("_total"), F.sum("_pc").over(whole).alias("_rows"),
    ), "offsets")
    matched = rows["_part"] == offsets["_key0"]
    if group is not None:
        matched &= same(rows[group], offsets["_key1"])
    before = F.col("_os") + F.col("_sum")
    return rows.join(small(offsets, offsets.count()), matched).select(
        *df.columns, (F.pmod(before, F.lit(modulus)) if modulus else before).alias("_before"), (F.col("_oc") + F.col("_count")).alias("_row"), "_total", "_rows"
    )
