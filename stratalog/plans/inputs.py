"""The driver's tables as logs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import text, utf8
from ..operators import runs

#: The events log in SQL: k is the key as text.
LOG = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, user_id::VARCHAR AS k, value, props, ts FROM events)"
NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM log) WHERE n = 1)"
#: Runs of a thousand seqs, newest entry of a key in each; every third run lies on level 1.
RUNS = """runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, run_id, k ORDER BY seq DESC) AS n
  FROM (SELECT *, seq // 1000 AS run_id, CASE WHEN (seq // 1000) % 3 = 0 THEN 1 ELSE 0 END AS level FROM log)) WHERE n = 1)"""
MANIFEST = "manifest AS (SELECT level, run_id, min(k) AS min_key, max(k) AS max_key, count(*) AS entries FROM runs GROUP BY level, run_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The events log: seq, op, key and the asked columns."""
    rows = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return rows.select(F.col("event_id").alias("seq"), op.alias("op"), utf8(F.col("user_id").cast("string")).alias("key"), *(columns or ("value",)))


def key_text() -> Column:
    return text(F.col("key")).alias("k")


def event_runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    log = events(spark, sf_dir, *columns)
    run = F.floor(F.col("seq") / 1000).cast("long")
    return runs.split(log, run, F.when(run % 3 == 0, 1).otherwise(0))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.zone_map(event_runs(spark, sf_dir))
