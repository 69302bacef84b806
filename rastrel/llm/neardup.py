"""Near duplicates by MinHash with tensored banding.

Two collections of GROUPS short bands of ROWS minhashes each stand for GROUPS^2 tables: the key of table (i, j) joins
band i of the first and band j of the second collection. So 2 * GROUPS * ROWS minhashes, here 54, serve 81 tables of
keys of 6 minhashes, where one band per table would need 486. A pair of similarity s meets in some table with
probability (1 - (1 - s^ROWS)^GROUPS)^2: 0.9996 at 0.85, 0.9969 at 0.8, above that nearly 1.

Texts with equal shingle sets (by 128-bit digests) are one class from the start. Of classes that share a key, each is compared with the
least, and components follow. The classes of keys that are then still in several components are compared once more,
by an exact filter on their rarest shingles. Every link that counts has been confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import map_batches, materialise, pieces, same, scratch, small, text_buffer
from .words import Words, mix, shingles

WIDTH = 5
#: Of 100: linked if 100 * intersection >= LEAST * union.
LEAST = 80
GROUPS = 9
ROWS = 3
_PART = 1 << 18


def _sets(batch: pa.RecordBatch, words: Words, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The shingles of a batch's texts, their offsets, and each text's distinct shingles in order."""
    hashes, ends = words.hashes(*text_buffer(batch.column(batch.schema.get_field_index("text"))))
    grams, offsets = shingles(hashes, ends, width)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        run = np.sort(grams[lo:hi])
        out.append(run[np.concatenate([[True], run[1:] != run[:-1]])] if hi > lo else run)
    return grams, offsets, out


def _set_id(run: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two longs."""
    digest = hashlib.blake2b(run.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _minima(grams: np.ndarray, at: np.ndarray, mask: np.uint64, factor: np.uint64) -> np.ndarray:
    """The least hash of each text's shingles, which start at at. One long text is taken in parts."""
    if len(at) > 1:
        return np.minimum.reduceat((grams ^ mask) * factor, at)
    return np.array([min(((grams[k : k + _PART] ^ mask) * factor).min() for k in range(0, len(grams), _PART))], np.uint64)


def sketches(docs: DataFrame, width: int = WIDTH, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, hi and lo (of the shingle set; null without shingles), left and right (bands, a long each)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        draws = np.random.default_rng(85).integers(0, 1 << 63, (2, 2 * groups * rows), dtype=np.uint64)
        masks, factors = draws[0] << np.uint64(1), draws[1] | np.uint64(1)
        with np.errstate(over="ignore"):
            for batch in pieces(batches):
                grams, offsets, sets = _sets(batch, words, width)
                full = np.flatnonzero(np.diff(offsets))
                bands = np.zeros((2 * groups, len(full)), np.uint64)
                if len(full):
                    at = offsets[:-1][full]
                    for k in range(2 * groups * rows):
                        low = _minima(grams, at, masks[k], factors[k])
                        bands[k // rows] += mix(low + np.uint64(k % rows)) * np.uint64(2 * (k % rows) + 1)
                lists = []
                counts = np.zeros(batch.num_rows, np.int32)
                counts[full] = groups
                cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                for side in (bands[:groups], bands[groups:]):
                    lists.append(pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(side.T).reshape(-1).view(np.int64))))
                ids = [_set_id(s) if len(s) else (None, None) for s in sets]
                halves = [pa.array([i[k] for i in ids], pa.int64()) for k in range(2)]
                columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *halves, *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "hi", "lo", "left", "right"])

    schema = f"doc_id {kind}, n_shingles long, hi long, lo long, left array<long>, right array<long>"
    return map_batches(docs.select("doc_id", "text"), sketch, schema)


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """class, shingles of rows of docs (text, class, hi, lo) whose text has the set of that id."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches):
            wanted = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("class", "hi", "lo")), strict=True)
            rows = [(c, s) for (c, *of), s in zip(wanted, _sets(batch, words, width)[2], strict=True) if len(s) and _set_id(s) == tuple(of)]
            cuts = np.concatenate([[0], np.cumsum([len(s) for _, s in rows])]).astype(np.int32)
            flat = np.concatenate([s for _, s in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["class", "shingles"])

    return map_batches(docs.select("text", "class", "hi", "lo"), gather, "class long, shingles array<long>")


def _meeting(classes: DataFrame, side: str) -> DataFrame:
    """The classes that share a band of this side with another one."""
    bands = classes.select("class", F.posexplode(side).alias("at", "band"))
    shared = bands.groupBy("at", "band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = materialise(shared, "bands")
    return bands.join(shared, ["at", "band"], "left_semi").select("class").distinct()


def _confirmed(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b) those linked. Sizes too far apart rule a pair out before its sets are fetched."""
    of = lambda name, df, value: df.select(F.col("class").alias(name), F.col(value).alias(f"{value}_{name}"))
    sized = pairs.join(of("a", sizes, "n"), "a").join(of("b", sizes, "n"), "b").where(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    both = sized.join(of("a", sets, "shingles"), "a").join(of("b", sets, "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    return both.select("a", "b", "n_a", "n_b", common.alias("common")).where(100 * F.col("common") >= least * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _links(docs: DataFrame, classes: DataFrame, once: bool, width: int, least: int) -> DataFrame | None:
    """node, root of the classes (class, hi, lo, rep, n, left, right) that some other class is linked with."""
    left, right = _meeting(classes, "left"), _meeting(classes, "right")
    likely = materialise(classes.join(left, "class", "left_semi").join(right, "class", "left_semi"), "likely")
    tables = likely.select("class", F.posexplode("left").alias("i", "x"), "right").select("class", "i", "x", F.posexplode("right").alias("j", "y"))
    keys = tables.select("class", F.xxhash64("i", "x", "j", "y").alias("key"))
    heads = materialise(keys.groupBy("key").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "heads")
    met = materialise(keys.join(heads, "key").where("class <> head"), "met")
    pairs = met.select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(likely.select("class", "hi", "lo", "rep", "n"), "class")
    wanted = materialise(wanted, "wanted")
    count = wanted.count()
    if not count:
        return None
    sizes = small(wanted.select("class", "n"), count)
    fetch = small(wanted.select("class", "hi", "lo", "rep"), count)
    texts = docs.select("doc_id", "text").join(fetch, same(docs["doc_id"], fetch["rep"])).select("text", "class", "hi", "lo")
    sets = shingle_sets(texts, width)
    sets = materialise(sets if once else sets.dropDuplicates(["class"]), "sets")

    links = materialise(_confirmed(pairs, sizes, sets, least), "links")
    roots = materialise(components(links), "roots")
    index = _rarest(_open(met.select("key", "class"), roots), sets, sizes, least)
    for every in (False, True) if index is not None else ():
        minor, rows = _minor(index, roots)
        more = _meetings(minor, rows, least) if every else _with_heads(minor, least)
        more = more.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()
        more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = materialise(_confirmed(more, sizes, sets, least), "links")
        if found.limit(1).count():
            pairs, roots = pairs.union(more), materialise(components(found, roots), "roots")
    return roots


def _rarest(rows: DataFrame, sets: DataFrame, sizes: DataFrame, least: int) -> DataFrame | None:
    """shingle, class, n, rest for the classes of rows (key, class, label): an index for exact prefix filtering.

    With the shingles of every class in one order, the rarest first, two classes that are similar enough share one of
    the first n - ceil(n * least / 100) + 1, and only those are in the index; rest counts a class's shingles from
    there on. Many versions of one text differ in just these, so only versions with rare shingles in common meet.
    """
    classes = materialise(rows.select("class").distinct(), "open")
    count = classes.count()
    if not count:
        return None
    each = sets.join(small(classes, count), "class").select("class", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = materialise(each.join(often, "shingle"), "shared")
    m = shared.groupBy("class").agg(F.count(F.lit(1)).alias("m"))
    m = materialise(m.join(sizes, "class").where(100 * F.col("m") >= least * F.col("n")), "shared-sizes")
    rarest = Window.partitionBy("class").orderBy("k", "shingle")
    first = F.col("m") - F.floor((least * F.col("n") + 99) / 100) + 1
    placed = shared.join(small(m, count), "class").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= first)
    return materialise(placed.select("shingle", "class", "n", (F.col("m") - F.col("place") + 1).alias("rest")), "index")


def _minor(index: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index's rows with their labels, and those of them, with the head's values, that are under their shingle not
    of its largest component. The head is the one of that component with the most shingles left."""
    rows = materialise(_labelled(index, roots), "labelled")
    weights = rows.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
    weights = materialise(weights, "weights")
    head = F.max(F.struct("weight", F.col("label").alias("top"), "rest", "class", "n")).alias("h")
    tops = rows.join(small(weights, weights.count()), "label").groupBy("shingle").agg(head, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    tops = materialise(tops.select("shingle", "h.top", F.col("h.class").alias("class_b"), F.col("h.n").alias("n_b"), F.col("h.rest").alias("rest_b")), "tops")
    return materialise(rows.join(tops, "shingle").where("label <> top").withColumnsRenamed({c: f"{c}_a" for c in ("class", "label", "n", "rest")}), "minor"), rows


def _enough(least: int) -> Column:
    """Whether a shingle can be the first that two classes have in common: what is left of both from there on is enough
    for the overlap that a link takes."""
    return (100 + least) * F.least("rest_a", "rest_b") >= least * (F.col("n_a") + F.col("n_b"))


def _with_heads(minor: DataFrame, least: int) -> DataFrame:
    return minor.where(_enough(least))


def _meetings(minor: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Rows of minor with all of another component under the same shingle."""
    b = rows.withColumnsRenamed({c: f"{c}_b" for c in ("class", "label", "n", "rest")})
    once = (F.col("label_b") == F.col("top")) | (F.col("class_a") < F.col("class_b"))
    return minor.drop("class_b", "n_b", "rest_b").join(b, "shingle").where((F.col("label_a") != F.col("label_b")) & once & _enough(least))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (class, ...) with label, the root of the class's component or the class itself."""
    labels = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(labels, rows["class"] == labels["_node"], "left").select(*rows.columns, F.coalesce("_root", "class").alias("label"))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, class) with label, of keys with more than one label."""
    return _divided(_labelled(rows, roots))


def _divided(rows: DataFrame) -> DataFrame:
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return rows.join(keys, "key", "left_semi")


def near_groups(docs: DataFrame, width: int = WIDTH, least: int = LEAST, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    A text's set is its distinct shingles of width words (A-Z lower-cased, white space U+0020 and U+0009 to U+000D);
    with fewer words the whole sequence is its only shingle. A null text and one without words have an empty set and
    are linked with nothing. component_id is the smallest doc_id of the component, null if no row of it has an id;
    kept rows are those whose doc_id it is, repeats included. An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        members = keep(materialise(sketches(docs, width, groups, rows), "sketches"))
        once = not members.groupBy("doc_id").count().where("count > 1").limit(1).count()
        first = [F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("left", "left"), ("right", "right"))]
        classes = members.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *first)
        numbered = classes.sortWithinPartitions("hi", "lo").select(F.monotonically_increasing_id().alias("class"), "*")
        classes = materialise(numbered, "classes")  # read back, the numbers stay
        roots = _links(docs, classes, once, width, least)
        narrow = classes.select("class", "hi", "lo", "rep", "copies")
        if roots is None:
            named = narrow.where("copies > 1").select("hi", "lo", F.col("rep").alias("least_id"))
        else:
            joined = narrow.join(roots, narrow["class"] == roots["node"], "left").where("copies > 1 or root is not null")
            joined = materialise(joined.select("hi", "lo", "rep", F.coalesce("root", "class").alias("root")), "joined")
            least_ids = materialise(joined.groupBy("root").agg(F.min("rep").alias("least_id")), "least")
            named = joined.join(least_ids, "root").select("hi", "lo", "least_id")
        named = keep(materialise(named.withColumn("grouped", F.lit(True)), "named"))
    out = members.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("grouped"), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", same(F.col("doc_id"), F.col("component_id")))


def _row(docs: DataFrame) -> Column:
    """What tells the rows of docs apart: the doc_id, present ones first, and a hash of the whole row."""
    named = [(F.col(f"`{c}`"), kind) for c, kind in docs.dtypes]
    row = F.xxhash64(*[c for c, kind in named if "map<" not in kind], *[c.isNull() for c, _ in named])
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), row.alias("row"))


def drop_near(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of docs, with all their columns, of which one row of each component stays: one with its least doc_id,
    or without an id if no row of it has one. Rows are decided on one by one, by their own texts, whatever ids they
    share or lack. Rows without words are in no component, so that all of them stay. An empty table gives no rows."""
    keyed = docs.select("*", _row(docs).alias("_row"))
    marks = materialise(near_groups(keyed.select(F.col("_row").alias("doc_id"), "text"), **settings), "marks")
    gone = marks.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = small(gone, gone.count())
    left = keyed.join(gone, same(F.col("_row"), F.col("_gone")), "left_anti")
    again = marks.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialise(again.select(F.col("doc_id").alias("_again")), "again")
    if count := again.count():  # rows alike in every column
        again = small(again, count)
        alike = same(F.col("_row"), F.col("_again"))
        left = left.join(again, alike, "left_anti").union(left.join(again, alike, "left_semi").dropDuplicates(["_row"]))
    return left.drop("_row")
