"""Mixing sources to target weights by systematic sampling.

Every document expects target / size copies of its source. The expected copies are summed up within the source, in
order of size, from one random start; a document is taken once for each whole number its own span crosses. The words
taken from a source thus miss its target by about one document, and reruns agree: the start comes from the seed and
the source's name, and all sums are whole numbers (2^32 to a copy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, prefixed, same, small

#: By source in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Of all sizes, what the mix holds.
SHARE = 1.5
#: A source gives at most so many times its own size.
MOST = 2
SEED = "mix-1"
_ONE = 1 << 32
_PARTS = 1 << 20


def word_count(text: Column) -> Column:
    """Words of the white space U+0020 and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, size), with any number of sources: ranks and sums over sources are
    prefix sums like those over documents. Weights are rounded to a millionth part or so.

    Sources fill up in the order of most * size / weight; the target of the others is their weight times the level
    at which what is left, shared by weight, fills none of the rest. Null is a source, the last; a table without rows
    gives no rows; null sizes count for nothing.
    """
    by_source = materialise(sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")), "sources")
    last = F.col("source").asc_nulls_last()
    named = prefixed(by_source, [last], "source_size", tag="named")
    choice = F.array(*[F.lit(round(w * _PARTS)) for w in weights])
    known = named.select("source", "source_size", F.get(choice, F.pmod("_row", F.lit(len(weights)))).cast("long").alias("_weight"), F.col("_total").alias("_all"))
    ratio = F.col("source_size") * float(most) / (F.col("_weight") / _PARTS)
    order = [ratio, last]
    filled = prefixed(known, order, "source_size", tag="filled").select(*known.columns, F.col("_before").alias("_filled"))
    filled = prefixed(filled, order, "_weight", tag="weighed")
    level = (F.col("_all") * float(share) - F.col("_filled") * float(most)) / ((F.col("_total") - F.col("_before")) / _PARTS)
    ranked = materialise(filled.select("source", "source_size", "_weight", "_row", level.alias("_level"), ratio.alias("_ratio")), "ranked")
    first = ranked.where("_level <= _ratio").agg(F.min(F.struct("_row", "_level"))["_level"]).first()[0]
    top = F.col("source_size") * float(most)
    target = top if first is None else F.least(top, F.lit(float(first)) * (F.col("_weight") / _PARTS))
    return ranked.select("source", "source_size", target.alias("target"))


def _start(seed: str) -> Column:
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("\0")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")


def _copies(sized: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and copies."""
    targets = materialise(source_targets(sized, weights, share, most), "targets")
    targets = small(targets.select(F.col("source").alias("_source"), "source_size", "target"), targets.count())
    step = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    expected = sized.join(targets, same(sized["source"], targets["_source"])).drop("_source").withColumn("_step", F.floor(step * _ONE).cast("long"))
    order = [F.col("source").asc_nulls_first(), F.col("size"), F.col("doc_id").asc_nulls_first()]
    summed = prefixed(expected, order, "_step", "source", _ONE, "mix")
    return summed.withColumn("copies", F.floor((F.pmod(F.col("_before") + _start(seed), F.lit(_ONE)) + F.col("_step")) / _ONE).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs (doc_id, text, source).

    Null texts have size 0; null is a source of its own, after the others; repeated rows and ties of size and id are
    interchangeable; an empty table gives no rows; a source without words has target 0 and is not taken; other
    columns are ignored. The texts are read once and never shuffled.
    """
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "words")
    return _copies(sizes, weights, share, most, seed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it is taken. Null texts and those without
    words are not taken; an empty table gives no rows; null ids and sources are values like others.

    The copies are worked out on narrow rows, which find their texts by doc_id and a hash of the whole row. Rows that
    are alike in every column are one there, and taken as often as all of them.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("_alike")), "words")
    taken = _copies(sizes, weights, share, most, seed).groupBy("doc_id", "_alike").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    taken = materialise(taken, "taken").select(F.col("doc_id").alias("_id"), F.col("_alike").alias("_hash"), "copies", "n")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_doc_id"), row.alias("_row"))
    found = packed.join(small(taken, taken.count()), same(F.col("_doc_id"), F.col("_id")) & (F.col("_row") == F.col("_hash")))
    if taken.where("n > 1").limit(1).count():
        found = found.where("n = 1").union(found.where("n > 1").dropDuplicates(["_id", "_hash"]))
    return found.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
