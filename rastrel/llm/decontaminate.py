"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

The index holds, for each word, the items with it and its BM25 impact there, divided by the item's own total, so that
a passage that contains the whole item scores 1 for it. The counts behind the impacts (items, items with the word,
mean length) are those of the whole benchmark, however it is cut into indexes. Items stand on shelves by length: the
passages for an item are windows of twice its shelf's stride, the power of two that is no less than its own length, so
any whole copy of it lies inside one, and no other item has a say in it.

Retrieval is block-max WAND over passages in bulk: words that could add no more than SLACK to any item are set aside,
for the others the highest impact within each block of items is summed up per passage, and only where that bound
reaches THRESHOLD less SLACK are the block's items scored in full. Nothing above THRESHOLD is missed. What is retrieved
counts if the 5-word runs of the item's question, and the words of its answer, are found in the passage.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import map_batches, materialise, pieces, text_buffer
from .words import MARKS, Words, shingles

WIDTH = 5
THRESHOLD = 0.5
SLACK = 0.2
#: Share of the question's runs of WIDTH words, and of the answer's words, that must be in the passage.
OVERLAP = 0.8
ANSWER = 0.5
#: Items and bytes of text of one index, the only data that goes to every task; more are taken in turn.
INDEX_ITEMS = 20_000
INDEX_BYTES = 32 << 20
#: Words of a stride at least.
LEAST_STRIDE = 16
#: Blocks of a shelf at most.
BLOCKS = 256
#: Cells, of a stride of words each, whose bounds are held at a time: a long text is taken in parts.
CELLS = 8192
_K1, _B = 1.2, 0.75
_GATE_BITS = 22


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence of a text of several is the answer."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


@dataclass
class Item:
    item_id: object
    runs: np.ndarray  # of the question
    width: int
    answer: np.ndarray


@dataclass
class Statistics:
    """Of a benchmark: its items with words, their mean length, and the items with each word of words (in order)."""

    items: int
    mean: float
    words: np.ndarray
    df: np.ndarray

    def idf(self, words: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.words, words)]
        return np.log1p((self.items - df + 0.5) / (df + 0.5))


def item_of(hasher: Words, item_id: object, text: str) -> Item:
    """The question and the answer of an item; where either has no words, the whole text is the question."""
    question, answer = (hasher_words(hasher, part) for part in question_and_answer(text))
    if not len(question) or not len(answer):
        question, answer = hasher_words(hasher, text), answer[:0]
    width = min(WIDTH, len(question))
    return Item(item_id, np.unique(shingles(question, np.array([0, len(question)]), width)[0]), width, np.unique(answer))


class Shelf:
    """The items of one passage length: impacts by item and, of the words not set aside, the highest impact by block."""

    def __init__(self, stride: int, items: list[Item], words: list[np.ndarray], vocabulary: np.ndarray, facts: Statistics, threshold: float, slack: float):
        self.stride, self.items, self.threshold, self.slack = stride, items, threshold, slack
        n, sizes = len(items), np.array([len(w) for w in words])
        term, count = zip(*(np.unique(np.searchsorted(vocabulary, w), return_counts=True) for w in words), strict=True)
        item = np.repeat(np.arange(n), [len(t) for t in term])
        term, count = np.concatenate(term), np.concatenate(count).astype(float)
        impact = facts.idf(vocabulary[term]) * count * (_K1 + 1) / (count + _K1 * (1 - _B + _B * sizes[item] / facts.mean))
        impact /= np.bincount(item, impact)[item]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=n))])
        self.term, self.impact = term, impact

        mine, local = np.unique(term, return_inverse=True)
        order = np.lexsort((item, local))
        many = np.bincount(local)
        rows = np.concatenate([[0], np.cumsum(many)])
        room, needed = np.full(n, slack), np.ones(len(mine), bool)
        for t in np.argsort(-many, kind="stable"):
            at = order[rows[t] : rows[t + 1]]
            if (impact[at] <= room[item[at]]).all():
                room[item[at]] -= impact[at]
                needed[t] = False
        self.words = int(needed.sum())
        self.place = np.full(len(vocabulary), -1, np.int32)  # of a word of the vocabulary among the needed ones
        self.place[mine[needed]] = np.arange(self.words)

        self.per_block = max(4, -(-n // BLOCKS))
        self.blocks = -(-n // self.per_block)
        live = needed[local]
        pair = self.place[term[live]].astype(np.int64) * self.blocks + item[live] // self.per_block
        keys, inverse = np.unique(pair, return_inverse=True)
        self.bound = np.zeros(len(keys))
        np.maximum.at(self.bound, inverse, impact[live])
        self.block = keys % self.blocks
        self.rows = np.searchsorted(keys // self.blocks, np.arange(self.words + 1))

    def candidates(self, at: np.ndarray, term: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """document, first word, one past the last, item, score of each passage and item with a score of at least
        threshold. at, term: the places of the words that the vocabulary has, and which they are."""
        cells = -(-np.diff(ends) // self.stride)
        first = np.concatenate([[0], np.cumsum(cells)])
        place = self.place[term]
        live = place >= 0
        doc = np.searchsorted(ends, at[live], side="right") - 1
        cell = first[doc] + (at[live] - ends[doc]) // self.stride
        once = np.unique(cell * self.words + place[live])
        total = int(first[-1])
        follows = np.ones(total, bool)
        follows[first[1:][cells > 0] - 1] = False
        flag = np.zeros(len(self.place), bool)
        for low in range(0, total, CELLS):
            for c, blocks in groupby(self._reached(once, low, min(total, low + CELLS), follows), key=itemgetter(0)):
                d = int(np.searchsorted(first, c, side="right")) - 1
                lo = int(ends[d] + (c - first[d]) * self.stride)
                hi = min(lo + 2 * self.stride, int(ends[d + 1]))
                seen = term[np.searchsorted(at, lo) : np.searchsorted(at, hi)]
                flag[seen] = True
                for _, block in blocks:
                    i = block * self.per_block
                    starts = self.starts[i : i + self.per_block + 1]
                    span = slice(starts[0], starts[-1])
                    scores = np.add.reduceat(np.where(flag[self.term[span]], self.impact[span], 0.0), starts[:-1] - starts[0])
                    for k in np.flatnonzero(scores >= self.threshold).tolist():
                        yield d, lo, hi, i + k, float(scores[k])
                flag[seen] = False

    def _reached(self, once: np.ndarray, low: int, high: int, follows: np.ndarray) -> Iterator[tuple[int, int]]:
        """The passages from cells low to high, each a cell and the one that follows it in its text, with the blocks
        whose bound can reach the threshold. once: cells and their needed words, as cell * words + word, in order."""
        n = self.words
        size = min(high + 1, len(follows)) - low
        cell, word = np.divmod(once[np.searchsorted(once, low * n) : np.searchsorted(once, (low + size) * n)], max(1, n))
        many = self.rows[word + 1] - self.rows[word]
        place = np.repeat(self.rows[word] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        key = np.repeat(cell - low, many) * self.blocks + self.block[place]
        bound = np.bincount(key, self.bound[place], minlength=size * self.blocks).reshape(size, self.blocks)
        joined = bound[: high - low].copy()
        on = np.flatnonzero(follows[low : min(high, low + size - 1)])
        joined[on] += bound[on + 1]
        for c, block in np.argwhere(joined >= self.threshold - self.slack - 1e-9).tolist():
            yield c + low, block


class Index:
    """The shelves of a part of a benchmark, and the words of its items."""

    def __init__(self, items: list[tuple[object, str | None]], facts: Statistics, threshold: float = THRESHOLD, slack: float = SLACK):
        hasher = Words(MARKS, fold=True)
        cut = [(i, t, w) for i, t in items if t and len(w := hasher_words(hasher, t))]
        self.vocabulary = np.unique(np.concatenate([w for _, _, w in cut])) if cut else np.zeros(0, np.uint64)
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self.vocabulary >> np.uint64(64 - _GATE_BITS)] = True
        shelves: dict[int, list] = {}
        for item_id, text, words in cut:
            stride = max(LEAST_STRIDE, 1 << (len(words) - 1).bit_length())
            shelves.setdefault(stride, []).append((item_of(hasher, item_id, text), words))
        self.shelves = [
            Shelf(stride, [x for x, _ in rows], [w for _, w in rows], self.vocabulary, facts, threshold, slack) for stride, rows in sorted(shelves.items())
        ]

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words that the vocabulary has, and which they are."""
        at = np.flatnonzero(self.gate[words >> np.uint64(64 - _GATE_BITS)])
        term = np.searchsorted(self.vocabulary, words[at])
        term[term == len(self.vocabulary)] = 0
        real = self.vocabulary[term] == words[at]
        return at[real], term[real]


def hasher_words(hasher: Words, text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return hasher.hashes(data, np.array([0, len(data)]))[0]


def passage_runs(passage: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles(passage, np.array([0, len(passage)]), width)[0])


def overlaps(item: Item, words: np.ndarray, runs: np.ndarray) -> tuple[float, float]:
    """The shares of the question's runs and of the answer's words that a passage has, its distinct words and runs
    given in order; without an answer 1."""
    answer = float(_in(item.answer, words).mean()) if len(item.answer) else 1.0
    return float(_in(item.runs, runs).mean()), answer


def _in(some: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, some)
    at[at == len(ordered)] = 0
    return ordered[at] == some


def _found(index: Index, batch: pa.RecordBatch, hasher: Words) -> dict[tuple[int, int, int], tuple[int, float, float, float]]:
    """(document, shelf, item): first word, score, overlap, answer overlap of the best confirmed passage."""
    words, ends = hasher.hashes(*text_buffer(batch.column(batch.schema.get_field_index("text"))))
    best: dict[tuple[int, int, int], tuple[int, float, float, float]] = {}
    if not len(words) or not index.shelves:
        return best
    at, term = index.known(words)
    for k, shelf in enumerate(index.shelves):
        for (d, lo, hi), rows in groupby(shelf.candidates(at, term, ends), key=itemgetter(0, 1, 2)):
            once, runs = np.unique(words[lo:hi]), {}
            for _, _, _, i, score in rows:
                item = shelf.items[i]
                if item.width not in runs:
                    runs[item.width] = passage_runs(words[lo:hi], item.width)
                overlap, answer = overlaps(item, once, runs[item.width])
                if overlap >= OVERLAP and answer >= ANSWER and (overlap, score) > best.get((d, k, i), (0, 0.0, 0.0, 0.0))[2:0:-1]:
                    best[d, k, i] = (lo - int(ends[d]), score, overlap, answer)
    return best


def item_terms(items: DataFrame) -> DataFrame:
    """part, n_words, terms (the distinct words' hashes) of rows (part, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Words(MARKS, fold=True)
        for batch in pieces(batches):
            words, ends = hasher.hashes(*text_buffer(batch.column(1)))
            lists = [np.unique(words[lo:hi]).view(np.int64) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(lists, pa.list_(pa.int64()))], names=["part", "n_words", "terms"])

    return map_batches(items.select("part", "text"), cut, "part int, n_words long, terms array<long>")


def indexes(benchmark: DataFrame, most: int = INDEX_ITEMS, most_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of the distinct items of benchmark (item_id, text), each of about most items and most_bytes of text, so
    that no more is held at once. Counts are taken over the whole benchmark, and by words, not on the driver."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    n, size = items.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // most), -(-size // most_bytes))
    if not parts:
        return
    items = materialise(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "items")
    terms = materialise(item_terms(items), "terms")
    live, mean = terms.where("n_words > 0").agg(F.count(F.lit(1)), F.avg("n_words")).first()
    if not live:
        return
    words = terms.select("part", F.explode("terms").alias("word"))
    df = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "df")
    for k in range(parts):
        rows = items.where(F.col("part") == k).select("item_id", "text").collect()
        if not rows:
            continue
        known = df.join(words.where(F.col("part") == k).select("word").distinct(), "word").toPandas()
        hashes = known["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        facts = Statistics(live, float(mean), hashes[order], known["df"].to_numpy(np.int64)[order])
        yield Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, str(r[0]), r[1])), facts)


def matches(docs: DataFrame, benchmark: DataFrame, most: int = INDEX_ITEMS) -> DataFrame:
    """doc_id, item_id, passage_start, score, overlap, answer_overlap: one row per row of docs (doc_id, text) and item
    that it contains, with the best passage. What is found does not depend on most, nor on what other items there are
    but for their counts of words.

    Documents and items without words match nothing; items of fewer than 5 words must be found as a whole; repeated
    documents are found each, repeated items (id and text alike) count once; a null doc_id stays null; an empty table
    gives no rows; other columns are ignored. Nothing of docs is shuffled; only an index of at most about most items
    goes to the tasks.
    """
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    numbers = [StructField(c, DoubleType()) for c in ("score", "overlap", "answer_overlap")]
    schema = StructType([StructField("doc_id", doc_kind), StructField("item_id", item_kind), StructField("passage_start", LongType()), *numbers])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    out = None
    for index in indexes(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher, index = Words(MARKS, fold=True), pickle.loads(shared.value)
            for batch in pieces(batches):
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                found = sorted(_found(index, batch, hasher).items())
                rows = [(ids[d].as_py(), index.shelves[k].items[i].item_id, *values) for (d, k, i), values in found]
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        part = map_batches(docs.select("doc_id", "text"), find, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = INDEX_ITEMS) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item.

    Rows are judged one by one by their own text: null and empty texts stay, repeated rows share one fate, ids are not
    read. An empty table gives no rows; without items all rows stay. Nothing of docs is shuffled.
    """
    out = docs
    for index in indexes(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher, index = Words(MARKS, fold=True), pickle.loads(shared.value)
            for batch in pieces(batches):
                gone = {d for d, _, _ in _found(index, batch, hasher)}
                yield batch.filter(pa.array([d not in gone for d in range(batch.num_rows)], pa.bool_()))

        out = map_batches(out, clean, docs.schema)
    return out
