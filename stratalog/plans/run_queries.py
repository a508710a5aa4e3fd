"""Runs, zone maps, pruning, integrity and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.codecs import text, utf8
from ..operators import runs, snapshots
from ..sources import sorted_file
from .inputs import LOG, MANIFEST, RUNS, event_runs, manifest, table

@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT level, run_id, min_key, max_key, entries FROM manifest")
def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("level", "run_id", text(F.col("min_key")).alias("min_key"), text(F.col("max_key")).alias("max_key"), "entries")


@query("SELECT l_orderkey // 500 AS run_id, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, count(*) AS entries FROM lineitem GROUP BY l_orderkey // 500")
def zone_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_orderkey") / 500).cast("long").alias("run_id"))
    return runs.zone_map(rows, ("run_id",), "l_orderkey")


@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT level, run_id FROM manifest WHERE level = 0 OR '42' BETWEEN min_key AND max_key")
def candidate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.candidates(manifest(spark, sf_dir), F.lit(b"42")).select("level", "run_id")


@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT level, count(*) AS files, sum(entries)::BIGINT AS entries FROM manifest GROUP BY level")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.level_stats(manifest(spark, sf_dir))


@query(f"WITH {LOG}, {RUNS} SELECT level, run_id, k, seq, op::INT AS op FROM runs")
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of all runs, tombstones included."""
    return event_runs(spark, sf_dir).select("level", "run_id", text(F.col("key")).alias("k"), "seq", "op")


@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT level, run_id, entries FROM manifest WHERE NOT (level = 0 AND run_id % 2 = 1) UNION ALL SELECT 1, 999, count(*) FROM manifest")
def manifest_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).select("level", "run_id", "entries")
    removed = rows.where("level = 0 AND run_id % 2 = 1").select("level", "run_id")
    added = rows.agg(F.count("*").alias("entries")).select(F.lit(1).alias("level"), F.lit(999).cast("long").alias("run_id"), "entries")
    return runs.replace(rows, removed, added)


@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT level, run_id FROM manifest WHERE level <> 0")
def level_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.clear_level(manifest(spark, sf_dir), 0).select("level", "run_id")


@query("SELECT p_name AS k, row_number() OVER (ORDER BY p_name COLLATE C, p_partkey) AS nth FROM part QUALIFY nth <= 50")
def key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 keys in byte order: a top-k report."""
    rows = table(spark, sf_dir, "part").select(utf8(F.col("p_name")).alias("key"), "p_partkey").orderBy("key", "p_partkey").limit(50)
    numbered = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("key", "p_partkey"))).alias("a")).select(F.posexplode("a").alias("i", "x"))
    return numbered.select(text(F.col("x.key")).alias("k"), (F.col("i") + 1).cast("long").alias("nth"))


@query("SELECT count(*) AS total_files, count(*) FILTER (WHERE f % 5 = 0) AS corrupted_files, string_agg(f::VARCHAR, ',' ORDER BY f) FILTER (WHERE f % 5 = 0) AS paths FROM (SELECT DISTINCT o_custkey % 50 AS f FROM orders)")
def integrity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted files of all orders, every fifth damaged in its footer; the check parses each and names the bad ones."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("f"), utf8(F.col("o_orderkey").cast("string")).alias("key"), F.lit(b"x").alias("value"))
    made = sorted_file.contents(rows, "f")
    cut = F.expr("substring(content, 1, cast(octet_length(content) - 8 as int))")
    made = made.withColumn("content", F.when(F.col("f") % 5 == 0, F.concat(cut, F.lit(b"\x7f" * 8))).otherwise(F.col("content")))
    checked = sorted_file.checked(made.withColumnRenamed("f", "path"))
    bad = F.sort_array(F.collect_list(F.when(~F.col("intact"), F.col("path"))))
    return checked.agg(F.count("*").alias("total_files"), F.count_if(~F.col("intact")).alias("corrupted_files"), F.array_join(F.transform(bad, lambda p: p.cast("string")), ",").alias("paths"))


@query(f"WITH {LOG}, {RUNS} SELECT level, run_id, count(*) AS entries, count(*) FILTER (WHERE NOT (length(k) BETWEEN 0 AND 10000000)) AS damaged FROM runs GROUP BY level, run_id")
def entries_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_runs(spark, sf_dir, "props")
    good = snapshots.entries_intact(F.col("key"), utf8(F.col("props")))
    return rows.groupBy("level", "run_id").agg(F.count("*").alias("entries"), F.count_if(~good).alias("damaged"))


@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT level, run_id, least(entries, 5) AS sampled FROM manifest")
def blocks_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_runs(spark, sf_dir).withColumn("file", F.struct("level", "run_id"))
    return snapshots.sampled(rows, "file").groupBy("level", "run_id").agg(F.count("*").alias("sampled"))


@query(f"WITH {LOG}, {RUNS}, {MANIFEST} SELECT count(*) AS total_files, sum(entries * 8)::BIGINT AS total_bytes FROM manifest")
def snapshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.totals(manifest(spark, sf_dir).withColumn("bytes", F.col("entries") * 8))


@query(f"WITH {LOG}, made AS (SELECT seq // 1000 AS run_id, max(ts) AS created_at FROM log GROUP BY seq // 1000) SELECT run_id FROM made WHERE created_at > (SELECT min(created_at) FROM made)")
def incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_runs(spark, sf_dir, "ts").groupBy("run_id").agg(F.max("ts").alias("created_at"))
    first = made.agg(F.min("created_at")).first()[0]
    return snapshots.since(made, F.lit(first)).select("run_id")
