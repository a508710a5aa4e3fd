"""A corpus pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import langid, mixing, packing, pii, simhash
from stratalog.llm.common import bounded, dropped, ship, stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ship(spark)
    bounded(spark)
    return langid.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    bounded(spark)
    return simhash.keep_first(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their sources' weights, as often as they are taken."""
    return mixing.taken_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of token ids."""
    ship(spark)
    bounded(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("near_duplicates", deduplicated),
    ("personal_data", sanitised),
    ("mixing", mixed),
    ("packing", packed),
]

#: Classification, fuzzy hashing and tokens can't be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            dropped(before)  # of the stages' outputs only the last is read on
    return STAGES[-1][1](spark, docs, sf_dir)
