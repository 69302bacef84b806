"""Exact duplicates by content-defined chunk recipes.

A text, without its white space, is cut where a hash of the bytes before a place says so, LEAST to MOST bytes after the
last cut: equal texts get equal chunks. Each chunk goes once to the chunk store, which groups by digest and bytes; if no digest there has two
different byte strings, the digest identifies the chunk and the ordered list of a text's digests, its recipe,
identifies the text. Only recipes and ids are compared and joined; the texts move once, as chunks, already
without the repeats inside each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, materialise, pieces, same, text_buffer
from .words import mix

#: A place is a cut if the hash of the 8 bytes before it has so many zero bits: chunks of 2 KB on average.
CUT_BITS = 11
LEAST = 256
MOST = 16 << 10
#: Bytes of chunks that a task keeps in mind to leave repeats out; then it forgets them and starts again.
SEEN_BYTES = 8 << 20
_SPAN = 1 << 20
_BLANK = bytes([0x20, *range(0x09, 0x0E)])


def _blake(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


#: Tried in turn until the store finds no digest of two chunks.
DIGESTS: tuple[Callable[[bytes], bytes], ...] = (_blake, _sha)


def normalise(text: bytes) -> bytes:
    """Without U+0020 and U+0009 to U+000D; in UTF-8 these bytes are part of no other character."""
    return text.translate(None, _BLANK)


def _places(data: bytes, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """The places whose 8 preceding bytes hash to bits zero bits, a span of data at a time, and the span's end."""
    for lo in range(0, len(data), _SPAN):
        part = np.frombuffer(data[max(0, lo - 7) : lo + _SPAN], np.uint8)
        if len(part) < 8:
            yield np.zeros(0, np.int64), len(data)
            return
        run = part.astype(np.uint64)
        run = run[1:] | (run[:-1] << np.uint64(8))
        run = run[2:] | (run[:-2] << np.uint64(16))
        run = run[4:] | (run[:-4] << np.uint64(32))
        yield np.flatnonzero((mix(run) >> np.uint64(64 - bits)) == 0) + max(0, lo - 7) + 8, min(lo + _SPAN, len(data))


def chunks(data: bytes, bits: int = CUT_BITS, least: int = LEAST, most: int = MOST) -> list[bytes]:
    """data cut at the first such place from least bytes after the last cut on, or most bytes after it."""
    out, kept = [], 0
    for places, end in _places(data, bits):
        while True:
            k = int(np.searchsorted(places, kept + least))
            at = min(int(places[k]) if k < len(places) else end + 1, kept + most)
            if at > end:
                break
            out.append(data[kept:at])
            kept = at
    return [*out, data[kept:]] if kept < len(data) else out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, ends = text_buffer(batch.column(batch.schema.get_field_index("text")))
    raw = data.tobytes()
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield normalise(raw[lo:hi])


def chunk_store(docs: DataFrame, digest: Callable[[bytes], bytes] = _blake, bits: int = CUT_BITS) -> DataFrame:
    """digest, chunk: every distinct chunk of the texts. Grouping compares the bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in pieces(batches):
            names, bodies = [], []
            for text in _texts(batch):
                for chunk in chunks(text, bits):
                    name = digest(chunk)
                    if seen.get(name) == chunk:
                        continue
                    names.append(name)
                    bodies.append(chunk)
                    if held > SEEN_BYTES:
                        seen.clear()
                        held = 0
                    seen[name] = chunk
                    held += len(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], names=["digest", "chunk"])

    return map_batches(docs.select("text"), cut, "digest binary, chunk binary").groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = _blake, bits: int = CUT_BITS) -> DataFrame:
    """doc_id, n_chars, n_chunks, recipe (the digests in order, joined), text_sha256."""

    def cook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists, counts, sums = [], [], []
            for text in _texts(batch):
                parts = chunks(text, bits)
                lists.append(b"".join(map(digest, parts)))
                counts.append(len(parts))
                sums.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(lists, pa.binary()), pa.array(sums, pa.string())], names=["doc_id", "n_chars", "n_chunks", "recipe", "text_sha256"])

    narrow = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(narrow, cook, f"doc_id {kind}, n_chars long, n_chunks long, recipe binary, text_sha256 string")


def exact_groups(docs: DataFrame, digests: Sequence[Callable[[bytes], bytes]] = DIGESTS, bits: int = CUT_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row of docs (doc_id, text).

    Of equal texts the row with the most code points, then the smallest doc_id, stays. Null texts are empty, and
    empty texts equal each other; rows without a doc_id come after those with one, and keep_id is null where no row
    of the group has one; ids may be of any type that has an order; repeated rows are members like others, and rows
    that repeat the kept doc_id are kept too. An empty table gives no rows; other columns are ignored.
    """
    for digest in digests:
        store = chunk_store(docs, digest, bits)
        if not store.groupBy("digest").count().where("count > 1").limit(1).count():
            break
    else:
        raise ValueError("two chunks share every digest")
    rows = materialise(recipes(docs, digest, bits), "recipes")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("first")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("recipe").alias("_recipe"), F.col("best.first").alias("keep_id"), "group_size")
    groups = materialise(groups, "groups")  # so that the join can split a hot recipe's rows
    return rows.join(groups, rows["recipe"] == groups["_recipe"]).select("doc_id", "keep_id", "group_size", same(F.col("doc_id"), F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks")
