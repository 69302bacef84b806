"""Host lists as Bloom filter cascades: exact membership without a join.

Level 0 is a Bloom filter of the listed keys, level 1 one of those keys of the corpus that level 0 takes for listed
and are not, level 2 one of the listed keys that level 1 takes for such, and so on until none is left. The first level
that a key misses tells whether it is listed. That is exact for every key of the universe the cascade was built over,
and the universe here is complete: every host of the corpus with its parent domains, as far up as a listed key goes.

A level is a table of bitmaps of 32768 bits, each key in one of them; a query holds it as a scalar subquery. What
only building joins is the few keys that level 0 lets through with the list. A list whose level 0 would take more
than MOST_BYTES is cut by a hash of the key into cascades that are asked one after another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: (host, path, verdict); the longest that fits wins.
RULES = (("org", "", "allow"), ("example.org", "es/", "block"), ("example.org", "en/1", "block"), ("com", "fr/", "allow"), ("com", "de/", "block"))
#: The domains blocked with all their subdomains.
LISTED = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
)
#: Bits for a key of a level at least; level 0 takes more, the fewer of the universe's keys are listed.
LEAST_BITS = 10
#: Bytes of the level 0 that a query holds at a time, at most.
MOST_BYTES = 32 << 20
#: Fixed value: bits of what bitmap_construct_agg makes.
_BITMAP = 32768


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; without ://, and for null, empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(name: Column, labels: int) -> list[Column]:
    """The host's last label, its last two, and so on up to labels of them; those of a shorter host repeat it."""
    return [F.substring_index(name, ".", -d) for d in range(1, labels + 1)]


@dataclass(frozen=True)
class Level:
    """A Bloom filter: table (bucket, bits), a row for each of its buckets; the number seeds the hashes."""

    table: DataFrame
    buckets: int
    hashes: int
    number: int

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(-1)), F.lit(self.buckets)).cast("int")

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(k)), F.lit(_BITMAP)).cast("int") for k in range(self.hashes)]

    def has(self, key: Column) -> Column:
        every = self.table.agg(F.array_sort(F.collect_list(F.struct("bucket", "bits")))["bits"].alias("bits")).scalar()
        bits, found = F.get(every, self._bucket(key)), F.lit(True)
        for place in self._places(key):
            byte = F.ascii(F.decode(F.substring(bits, F.shiftright(place, 3) + 1, 1), "ISO-8859-1"))
            found &= F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
        return found

    @staticmethod
    def of(keys: DataFrame, count: int, number: int, bits: int = LEAST_BITS) -> Level:
        """From the column key of keys, count rows."""
        empty = Level(keys, max(1, -(-count * bits // _BITMAP)), max(1, round(0.7 * bits)), number)
        key = F.col("key")
        rows = keys.select(empty._bucket(key).alias("bucket"), F.explode(F.array(*empty._places(key))).alias("place"))
        every = keys.sparkSession.range(empty.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("int").alias("place"))
        table = rows.union(every).groupBy("bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
        return replace(empty, table=materialise(table, "level"))


def build(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """The cascade over the column key of both tables, neither with a null or a repeated key."""
    inside, n, all_keys = listed, listed.count(), max(1, universe.count())
    bits = max(LEAST_BITS, math.ceil(1.5 * math.log2(all_keys / n))) if 0 < n < all_keys else LEAST_BITS
    levels = [Level.of(inside, n, 0, bits)]
    outside = materialise(universe.where(levels[0].has(F.col("key"))).join(listed, "key", "left_anti"), "passed")
    sides = [outside, inside]
    while count := sides[0].count():
        levels.append(Level.of(sides[0], count, len(levels)))
        sides = [materialise(sides[1].where(levels[-1].has(F.col("key"))), "passed"), sides[0]]
    return levels


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


def with_listed(rows: DataFrame, listed: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """rows (host, ...) with listed: whether the host or a parent domain of it is a key of listed (key). Null keys count
    for nothing, repeated ones once. rows is read once more than there are cascades, and never shuffled but for the
    distinct hosts that cascades are built over."""
    keys = materialise(listed.select("key").where("key is not null").distinct(), "listed")
    depth = F.coalesce(F.max(F.size(F.split("key", r"\.", -1))), F.lit(0))
    n, labels = keys.agg(F.count(F.lit(1)), depth).first()
    if not n:
        return rows.withColumn("listed", F.lit(False))
    universe = rows.select(F.explode(F.array(*domains(F.col("host"), labels))).alias("key")).distinct()
    universe = materialise(universe, "universe")
    parts = max(1, -(-n * LEAST_BITS // 8 // most))
    out = rows.withColumn("listed", F.lit(False))
    for part in range(parts):
        mine = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)) == part  # noqa: B023, E731
        cut = (lambda df: df.where(mine(F.col("key")))) if parts > 1 else (lambda df: df)  # noqa: B023, E731
        levels, found = build(cut(universe), cut(keys)), F.col("listed")
        for key in domains(F.col("host"), labels):
            found |= mine(key) & member(levels, key) if parts > 1 else member(levels, key)
        out = out.withColumn("listed", found)
        out = materialise(out, "asked") if part + 1 < parts else out
    return out


def fits(rule_host: str, rule_path: str, host_col: Column, path_col: Column) -> Column:
    named = (host_col == rule_host) | host_col.endswith(f".{rule_host}")
    return named & path_col.startswith(f"/{rule_path}") if rule_path else named


def judge(
    pages: DataFrame, listed: Sequence[str] | DataFrame = LISTED, rules: Sequence[tuple[str, str, str]] = RULES, most: int = MOST_BYTES
) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row of pages (page_id, url).

    A rule that fits decides, the longest first; else a url is blocked if its host or a parent domain of it is
    listed. A null url, or one without ://, has an empty host and path, fits no rule and is allowed unless the empty
    key is listed. Repeated rows are judged alike; an empty table gives no rows; an empty list blocks nothing; other
    columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    keys = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")
    rows = with_listed(rows, keys, most)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fit = fits(name, prefix, F.col("host"), F.col("path"))
        rule = F.when(fit, F.lit(f"{name}/{prefix}")).otherwise(rule)
        verdict = F.when(fit, F.lit(says)).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
