"""Sorted runs and the manifest that describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import latest

RUN = ("level", "run_id")


def split(log: DataFrame, run_id: Column, level: Column | int = 0) -> DataFrame:
    """Runs of a log: the newest entry of each key in each run."""
    level = level if isinstance(level, Column) else F.lit(level)
    rows = log.withColumn("level", level.cast("int")).withColumn("run_id", run_id.cast("long"))
    rows = rows.withColumn("__key", F.struct("level", "run_id", "key")).drop("level", "run_id", "key")
    return latest(rows, "__key").select("__key.*", *(c for c in rows.columns if c != "__key"))


def write(run: DataFrame, path: str, key: str = "key", files: int = 1, distinct: int = 0, mode: str = "overwrite") -> None:
    """One sorted run: files of disjoint key ranges. distinct sizes the key's Bloom filter, which is left out at 0."""
    out = run.repartitionByRange(files, key).sortWithinPartitions(key).write.mode(mode)
    if distinct:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
    out.parquet(path)


def read(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths)


def zone_map(runs: DataFrame, by: tuple[str, ...] = RUN, key: str = "key") -> DataFrame:
    """Smallest and largest key and number of entries of each run."""
    return runs.groupBy(*by).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("entries"))


def files(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """The manifest rows of a folder's files, from their contents and listing."""
    rows = spark.read.parquet(path).select(key, "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return rows.groupBy(F.col("file_path").alias("path")).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("entries"), F.max("file_size").alias("bytes"), F.max("file_modification_time").alias("created_at"))


def may_hold(key: Column, low: str = "min_key", high: str = "max_key") -> Column:
    """Whether a range may hold the key; bounds are inclusive, a missing one matches."""
    return F.coalesce(key.between(F.col(low), F.col(high)), F.lit(True))


def candidates(manifest: DataFrame, key: Column) -> DataFrame:
    """Runs that a lookup reads: all of level 0, below it those whose range holds the key."""
    return manifest.where((F.col("level") == 0) | may_hold(key))


def replace(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    return manifest.join(removed, ["level", "run_id"], "left_anti").unionByName(added)


def clear_level(manifest: DataFrame, level: int) -> DataFrame:
    return manifest.where(F.col("level") != level)


def level_stats(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count("*").alias("files"), F.sum("entries").alias("entries"))
