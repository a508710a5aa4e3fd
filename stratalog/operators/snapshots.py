"""Integrity checks, snapshots and incremental manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_KEY, MOST_VALUE = 10_000_000, 10_000_000, 100_000_000


def structural(files: DataFrame) -> DataFrame:
    """(path, intact) of (path, size, index_offset, entries); an empty index is fine."""
    good = (F.col("size") >= 8) & F.col("index_offset").between(0, F.col("size") - 9) & F.col("entries").between(0, MOST_ENTRIES)
    return files.select("path", F.coalesce(good, F.lit(False)).alias("intact"))


def entries_intact(key: Column, value: Column) -> Column:
    return F.coalesce(F.octet_length(key).between(0, MOST_KEY), F.lit(False)) & F.coalesce(F.octet_length(value).between(0, MOST_VALUE), F.lit(True))


def summary(checked: DataFrame) -> DataFrame:
    """(total_files, corrupted_files) of (path, intact)."""
    return checked.agg(F.count("*").alias("total_files"), F.count_if(~F.col("intact")).alias("corrupted_files"))


def sampled(rows: DataFrame, by: str, n: int = 5, order: str = "key") -> DataFrame:
    """The same n rows of each file every time."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(order), order))
    return rows.withColumn("__n", nth).where(F.col("__n") <= n).drop("__n")


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def since(manifest: DataFrame, moment: Column) -> DataFrame:
    """Files newer than the moment, and only those."""
    return manifest.where(F.col("created_at") > moment)
