"""Text quality by a factorisation machine.

A document is a row of features: the shares of its words by hash bucket, structure statistics of its bytes and words,
and its length column as metadata. The score is a logistic function of a bias, a linear term and all pairs of
features, each weighed by the product of two vectors of RANK numbers; the sum over pairs is half of the squared sum
less the sum of squares, so a score takes time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .shared import map_batches, pieces, text_buffer
from .words import SPACE, Words

BUCKET_BITS = 11
RANK = 8
#: Labelled rows, those with the least hashes of doc_id, that a model is fitted on at most.
MOST_ROWS = 4000
STEPS = 160
#: Texts per numpy pass: bounds the feature matrix.
ROWS = 512
THRESHOLD = 0.3
_CLASSES = (
    range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1), range(ord("0"), ord("9") + 1), range(128, 256), b".,;:", b"!?", b"%$#&*|<>=@^~_/\\+", b"'\"()[]{}-", b"\n",
)
_STATS = len(_CLASSES) + 7


def features(texts: pa.Array, n_chars: pa.Array, words: Words) -> np.ndarray:
    """A float32 row per text: the words' shares by bucket, then statistics. Null texts are empty, null lengths 0."""
    data, ends = text_buffer(texts)
    n, buckets = len(texts), 1 << BUCKET_BITS
    hashes, offsets = words.hashes(data, ends)
    counts = np.diff(offsets)
    row = np.repeat(np.arange(n), counts)
    bag = np.bincount(row * buckets + (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=n * buckets).reshape(n, buckets).astype(np.float32)
    many = np.maximum(counts, 1).astype(np.float32)
    bag /= many[:, None]
    size = np.diff(ends)
    length = np.maximum(size, 1)
    inside = np.zeros(256, np.uint8)
    stats = []
    for group in _CLASSES:
        inside[:] = 0
        inside[list(group)] = 1
        total = np.concatenate([[0], np.cumsum(inside[data], dtype=np.int64)])
        stats.append((total[ends[1:]] - total[ends[:-1]]) / length)
    again = np.zeros(n)
    if len(hashes) > 1:
        same = np.concatenate([[0], np.cumsum((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))])
        again = (same[np.maximum(offsets[1:] - 1, 0)] - same[np.minimum(offsets[:-1], len(same) - 1)]) / many
    chars = np.asarray(n_chars.cast(pa.float64()).fill_null(0.0))
    stats += [np.log1p(size) / 10, np.log1p(counts) / 10, (size / many) / 20, (bag > 0).sum(1) / np.minimum(many, buckets), bag.max(1), again, np.log1p(np.maximum(chars, 0)) / 10]
    return np.concatenate([bag * 4, np.stack(stats, 1).astype(np.float32)], axis=1)


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) * self.scale

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features()."""
        return 1 / (1 + np.exp(-self.logit(self.prepare(x))))

    def logit(self, z: np.ndarray) -> np.ndarray:
        pairs = ((z @ self.factors) ** 2).sum(1) - ((z * z) @ (self.factors * self.factors)).sum(1)
        return np.clip(self.bias + z @ self.linear + pairs / 2, -30, 30).astype(np.float64)


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> Model:
    """By Adam over all rows at once. Without rows, or with one label only, the score is the labels' share (0.5)."""
    width = x.shape[1]
    centre, scale = np.zeros(width, np.float32), np.ones(width, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Model(bias, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), centre, scale)
    tail = slice(width - _STATS, width)
    centre[tail], scale[tail] = x[:, tail].mean(0), 1 / (x[:, tail].std(0) + 1e-3)
    z = (x - centre) * scale
    z = np.clip(z, -8, 8)
    squares = z * z
    w, v, b = np.zeros(width, np.float32), np.random.default_rng(8).normal(0, 0.01, (width, RANK)).astype(np.float32), bias
    slow = [np.zeros_like(w), np.zeros_like(v), 0.0]
    fast = [np.zeros_like(w), np.zeros_like(v), 0.0]
    for t in range(1, steps + 1):
        inner = z @ v
        logit = b + z @ w + ((inner**2).sum(1) - (squares @ (v * v)).sum(1)) / 2
        g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        grads = [z.T @ g + decay * w, z.T @ (g[:, None] * inner) - v * (squares.T @ g)[:, None] + decay * v, float(g.sum())]
        for k, grad in enumerate(grads):
            slow[k] = 0.9 * slow[k] + 0.1 * grad
            fast[k] = 0.99 * fast[k] + 0.01 * grad * grad
        move = [0.03 * (slow[k] / (1 - 0.9**t)) / (np.sqrt(fast[k] / (1 - 0.99**t)) + 1e-8) for k in range(3)]
        w, v, b = w - move[0].astype(np.float32), v - move[1].astype(np.float32), b - float(move[2])
    return Model(b, w, v, centre, scale)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose label is never learned; null ids are among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST_ROWS) -> Model:
    """Fits labels (doc_id, target) of rows that are not held out, most of them at most; a row's label is the mean of
    its labels, rounded. Null ids and labels count for nothing. The features of these rows come to the driver."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.round(F.avg(target)).cast("int").alias("_y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "_y")
    rows = _inputs(docs).join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text", "n_chars")

    def row_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(SPACE, fold=False)
        for part in _parts(batches):
            x = features(part.column(2), part.column(3), words)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_pack(r) for r in x], pa.binary())], names=["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_batches(rows, row_features, f"doc_id {kind}, y int, x binary").orderBy("doc_id", "x").limit(most).toArrow()
    width = (1 << BUCKET_BITS) + _STATS
    x = np.stack([_unpack(r.as_py(), width) for r in got["x"]]) if got.num_rows else np.zeros((0, width), np.float32)
    return fit(x, np.asarray(got["y"], dtype=np.float32))


def _pack(row: np.ndarray) -> bytes:
    at = np.flatnonzero(row)
    return np.int32(len(at)).tobytes() + at.astype(np.int16).tobytes() + row[at].astype(np.float32).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    out = np.zeros(width, np.float32)
    out[np.frombuffer(data, np.int16, n, 4)] = np.frombuffer(data, np.float32, n, 4 + 2 * n)
    return out


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", _chars(docs))


def _chars(docs: DataFrame) -> Column:
    known = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return known.alias("n_chars")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, n_chars and any others) with score."""
    at = {name: docs.columns.index(name) for name in ("text", "n_chars")}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(SPACE, fold=False)
        for part in _parts(batches):
            x = features(part.column(at["text"]), part.column(at["n_chars"]), words)
            kept = [c for k, c in enumerate(part.columns) if k not in at.values()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(x), pa.float64())], names=[*[c for c in part.schema.names if c not in at], "score"])

    schema = StructType([f for f in docs.schema.fields if f.name not in at]).add("score", DoubleType())
    return map_batches(docs, apply, schema)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text, n_chars if there).

    Null and empty texts get the score of an empty text; repeated rows score alike; an empty table gives no rows;
    other columns, language and source among them, are ignored. Nothing is shuffled.
    """
    rows = _scored(_inputs(docs), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold. Null texts are scored as empty ones;
    repeated rows share one fate; an empty table gives no rows. Columns may have any names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select("text", _chars(docs), whole)
    return _scored(rows, model).where(F.col("score") >= threshold).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
