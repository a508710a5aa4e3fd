"""The mutation log: append, lookups, and the newest version of each key.

A log has seq (unique, larger is newer), op (1 put, 2 delete), key, and value columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DELETE, DELETE_COST, PUT, PUT_COST

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The newest row of each key, tombstones included.

    Fixed-width columns are aggregated by hash with partial results before the shuffle;
    others go through a rank that drops older rows on both sides of it. So a hot key
    sends one row a task either way.
    """
    rest = [f for f in log.schema.fields if f.name not in (key, seq)]
    if all(isinstance(f.dataType, FIXED) and not isinstance(f.dataType, T.DecimalType) for f in rest):
        return log.groupBy(key).agg(F.max(seq).alias(seq), *(F.max_by(f.name, seq).alias(f.name) for f in rest)).select(*log.columns)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    return log.withColumn("__n", newest).where("__n = 1").drop("__n")


def live(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Newest rows without deleted keys. The op filter comes after the choice: a delete hides older puts."""
    return latest(log, key, seq).where(F.col("op") == PUT)


def get(log: DataFrame, key: Column | bytes | str) -> DataFrame:
    """The live row of one key, or none. The filter reaches the scan."""
    return live(log.where(F.col("key") == (key if isinstance(key, Column) else F.lit(key))))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Each asked key with its live row, nulls where it has none."""
    found = live(log.join(keys.select("key").distinct(), "key", "left_semi"))
    return keys.join(found, "key", "left")


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log with puts of (seq, key, value...)."""
    return log.unionByName(rows.withColumn("op", F.lit(PUT).cast(log.schema["op"].dataType)))


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """log with tombstones of (seq, key); keys that aren't there may be deleted too."""
    return log.unionByName(keys.select("seq", "key", F.lit(DELETE).cast(log.schema["op"].dataType).alias("op")), allowMissingColumns=True)


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows whose key isn't listed."""
    return rows.join(keys, "key", "left_anti")


def layered(*newest_first: DataFrame) -> DataFrame:
    """Newest rows over several layers; a key of an earlier layer hides it in later ones, whatever its seq."""
    tagged = [layer.withColumn("__layer", F.lit(-i)) for i, layer in enumerate(newest_first)]
    both = reduce(DataFrame.unionByName, tagged)
    top = F.row_number().over(Window.partitionBy("key").orderBy(F.col("__layer").desc(), F.col("seq").desc()))
    return both.withColumn("__n", top).where("__n = 1").drop("__n", "__layer")


def entry_bytes(value: Column | None = None) -> Column:
    """Memory that an entry counts for."""
    size = F.coalesce(F.octet_length(value if value is not None else F.col("value")), F.lit(0))
    return F.when(F.col("op") == DELETE, F.octet_length("key") + DELETE_COST).otherwise(F.octet_length("key") + size + PUT_COST).cast("long")


def batches_full(log: DataFrame, batch: Column, limit: int, value: Column | None = None) -> DataFrame:
    """(batch, bytes, full): the memory of each batch's newest entries; full is strict."""
    kept = latest(log.withColumn("__batch", batch).withColumn("__key", F.struct("__batch", "key")).withColumn("__bytes", entry_bytes(value)).select("__key", "seq", "__bytes"), "__key")
    return kept.groupBy(F.col("__key.__batch").alias("batch")).agg(F.sum("__bytes").alias("bytes")).withColumn("full", F.col("bytes") > limit)


def scan(log: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Live rows in key order, from low on and below high."""
    some = log if low is None else log.where(F.col("key") >= low)
    some = some if high is None else some.where(F.col("key") < high)
    return live(some).orderBy("key")
