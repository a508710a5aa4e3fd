"""Replay of ordered logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log import latest


def valid_prefix(log: DataFrame, intact: Column, order: str = "seq", by: str | None = None) -> DataFrame:
    """Rows before the first damaged one (of each segment): one scalar a segment, no global sort."""
    bad = F.min(F.when(~F.coalesce(intact, F.lit(False)), F.col(order))).alias("__bad")
    if by is None:
        return log.crossJoin(F.broadcast(log.agg(bad))).where(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")
    return log.join(log.groupBy(by).agg(bad), by).where(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")


def after(log: DataFrame, applied: int, order: str = "seq") -> DataFrame:
    """Rows that a replica at this offset hasn't applied."""
    return log.where(F.col(order) > applied)


def replayed(*logs: DataFrame, order: str = "seq") -> DataFrame:
    """The union of logs in which a position counts once: replaying twice changes nothing."""
    first, *rest = logs
    for log in rest:
        first = first.unionByName(log)
    return first.dropDuplicates([order])


def segment_compacted(log: DataFrame, segment: Column) -> DataFrame:
    """The last entry of each key in each segment."""
    rows = log.withColumn("__segment", segment).withColumn("__key", F.struct("__segment", "key")).drop("__segment", "key")
    return latest(rows, "__key").select(F.col("__key.__segment").alias("segment"), F.col("__key.key").alias("key"), *(c for c in rows.columns if c != "__key"))


def truncated(log: DataFrame, flushed: int, order: str = "seq") -> DataFrame:
    """The log without what is in runs already."""
    return log.where(F.col(order) > flushed)
