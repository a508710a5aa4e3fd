"""Compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import compaction, log, runs
from .inputs import LOG, MANIFEST, NEWEST, RUNS, event_runs, events, key_text, manifest, table

@query(f"WITH {LOG}, {RUNS}, {MANIFEST}, c AS (SELECT level, count(*) AS files FROM manifest GROUP BY level) SELECT level, files, CASE WHEN level = 0 THEN 4 ELSE pow(10, level)::INT END AS threshold, files >= CASE WHEN level = 0 THEN 4 ELSE pow(10, level)::INT END AS due FROM c")
def compaction_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.due(runs.level_stats(manifest(spark, sf_dir)))


@query("WITH z AS (SELECT l_suppkey AS r, min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem GROUP BY l_suppkey) SELECT x.r AS left_run, y.r AS right_run FROM z x JOIN z y ON x.b >= y.a AND x.a <= y.b WHERE x.r % 4 = 0 AND y.r % 4 <> 0")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs: every fourth lies on the upper level, the others below."""
    zones = runs.zone_map(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), "l_orderkey"), ("run_id",), "l_orderkey")
    return compaction.overlap_pairs(zones.where("run_id % 4 = 0 AND min_key IS NOT NULL"), zones.where("run_id % 4 <> 0 AND min_key IS NOT NULL"))  # in SQL a null meets nothing


@query("WITH z AS (SELECT l_suppkey AS r, min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem GROUP BY l_suppkey) SELECT x.r AS run_id, count(y.r) AS overlaps FROM z x LEFT JOIN z y ON x.b >= y.a AND x.a <= y.b AND x.r <> y.r GROUP BY x.r")
def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run of the whole table, how many others it overlaps."""
    zones = runs.zone_map(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), "l_orderkey"), ("run_id",), "l_orderkey")
    known = zones.where("run_id IS NOT NULL AND min_key IS NOT NULL")  # in SQL a null meets nothing
    return zones.select("run_id").join(compaction.overlap_counts(known), "run_id", "left").select("run_id", F.coalesce("overlaps", F.lit(0).cast("long")).alias("overlaps"))


@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT level, run_id FROM manifest WHERE max_key >= '3' AND min_key <= '5'")
def overlapping_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.overlapping(manifest(spark, sf_dir), F.lit(b"3"), F.lit(b"5")).select("level", "run_id")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1")
def compacted_equals_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 merged into the next leaves every key's live value."""
    rows = event_runs(spark, sf_dir)
    one = compaction.compact(rows, runs.zone_map(rows), 0, 1_000_000)
    return log.live(one.drop("level", "run_id")).select(key_text(), "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1")
def compaction_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged into the lowest level, tombstones go."""
    return compaction.merge(event_runs(spark, sf_dir).drop("level", "run_id"), bottom=True).select(key_text(), "seq", "value")


@query(f"WITH {LOG}, {RUNS} SELECT level, run_id, sum(length(k) + length(props) + 8)::BIGINT AS bytes FROM runs GROUP BY level, run_id")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(spark, sf_dir, "props").groupBy("level", "run_id").agg(F.sum(compaction.file_bytes(F.encode("props", "UTF-8"))).alias("bytes"))


@query(f"WITH {LOG}, {RUNS} SELECT level, run_id, greatest(1, ceil(sum(length(k) + length(props) + 8) / 500.0))::BIGINT AS files FROM runs GROUP BY level, run_id")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each run is cut into, at a target of 500 bytes."""
    sizes = file_sizes(spark, sf_dir)
    return sizes.select("level", "run_id", compaction.files_of(F.col("bytes"), 500).alias("files"))


@query(f"WITH {LOG}, {NEWEST} SELECT count(*) AS entries, 0::BIGINT AS overlaps FROM newest")
def split_ranges_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged run is cut by range: no key lies in two files' ranges."""
    merged = compaction.merge(events(spark, sf_dir)).repartitionByRange(4, "key").withColumn("run_id", F.spark_partition_id().cast("long"))
    zones = runs.zone_map(merged, ("run_id",))
    a, b = zones.alias("a"), zones.select(F.col("run_id").alias("other"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    pairs = a.join(b, (F.col("run_id") < F.col("other")) & (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi")))
    both = zones.select("entries", F.lit(0).alias("o")).unionByName(pairs.select(F.lit(0).cast("long").alias("entries"), F.lit(1).alias("o")))
    return both.agg(F.sum("entries").alias("entries"), F.sum("o").cast("long").alias("overlaps"))
