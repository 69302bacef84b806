"""A training-data pipeline of corpus operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rastrel.llm import decontaminate, mixing, neardup, quality, sharding
from rastrel.llm.shared import drop, materialise, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Each stage takes whole rows, with any further columns, whatever their names. Rows are decided on one by one, so
# null ids and repeated rows need no care; null texts count as empty; an empty table gives an empty table.


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Null and empty texts all have one score, and rows that
    repeat each other one fate; without labelled rows the score is 0.5 and all stay."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: runs of five words, similarity 0.8 or more. Of rows that repeat
    each other one stays; null and empty texts are near nothing and stay."""
    return neardup.drop_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item. Null and empty texts stay; without items all stay."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; null is a source, the last. Texts without words, null
    ones among them, have no share in a mix and are not taken."""
    return mixing.emit(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, by size in order of id, null ids first; every repeat has its own slot."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good), ("near-duplicates", drop_near), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", cut_shards),
]

#: The classifier has no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents under sf_dir. What a stage made on its way goes when its output is
    written, and its input with it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            written = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        drop(docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
