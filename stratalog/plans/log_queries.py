"""Lookups and writes on the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.codecs import utf8
from ..operators import log, membership, recovery
from .inputs import LOG, NEWEST, events, key_text, table

@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.live(events(spark, sf_dir)).select(key_text(), "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, props FROM newest WHERE op = 1")
def latest_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.live(events(spark, sf_dir, "props")).select(key_text(), "seq", "props")


@query("SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return log.latest(rows, "k").select("k", "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1 AND k = '42'")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is asked for in its own type, so that the filter reaches the scan."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("op"), F.col("user_id").alias("key"), "value")
    return log.get(rows, F.lit(42)).select(F.col("key").cast("string").alias("k"), "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT c_custkey::VARCHAR AS k, seq, value FROM customer LEFT JOIN (SELECT * FROM newest WHERE op = 1) ON k = c_custkey::VARCHAR")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key is asked for."""
    keys = table(spark, sf_dir, "customer").select(utf8(F.col("c_custkey").cast("string")).alias("key"))
    return log.multi_get(events(spark, sf_dir), keys).select(key_text(), "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq FROM newest WHERE op = 2")
def tombstone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest(events(spark, sf_dir)).where("op = 2").select(key_text(), "seq")


@query(
    """WITH log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, user_id::VARCHAR AS k, value FROM events
  UNION ALL SELECT 1000000000 + c_custkey, 1, c_custkey::VARCHAR, c_acctbal FROM customer), """
    + NEWEST
    + " SELECT k, seq, value FROM newest WHERE op = 1"
)
def put_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("seq"), utf8(F.col("c_custkey").cast("string")).alias("key"), F.col("c_acctbal").alias("value"))
    return log.live(log.put(events(spark, sf_dir), rows)).select(key_text(), "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1 AND k NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)")
def delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("seq"), utf8(F.col("s_suppkey").cast("string")).alias("key"))
    return log.live(log.delete(events(spark, sf_dir), keys)).select(key_text(), "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, CASE WHEN op = 2 THEN length(k) + 16 ELSE length(k) + length(props) + 32 END::BIGINT AS bytes FROM newest")
def size_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest(events(spark, sf_dir, "props")).select(key_text(), log.entry_bytes(utf8(F.col("props"))).alias("bytes"))


@query(
    f"""WITH {LOG}, entries AS (SELECT batch, bytes FROM (SELECT seq // 1000 AS batch, CASE WHEN op = 2 THEN length(k) + 16 ELSE length(k) + length(props) + 32 END AS bytes,
  row_number() OVER (PARTITION BY seq // 1000, k ORDER BY seq DESC) AS n FROM log) WHERE n = 1)
SELECT batch, sum(bytes)::BIGINT AS bytes, sum(bytes) > 6000 AS "full" FROM entries GROUP BY batch"""
)
def memtable_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.batches_full(events(spark, sf_dir, "props"), F.floor(F.col("seq") / 1000).cast("long"), 6000, utf8(F.col("props")))


@query(
    f"""WITH {LOG}, tagged AS (SELECT *, seq >= (SELECT max(seq) FROM log) // 2 AS active FROM log),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY active DESC, seq DESC) AS n FROM tagged)
SELECT k, seq, op::INT AS op, value FROM best WHERE n = 1"""
)
def active_over_immutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    half = F.floor(F.lit(rows.agg(F.max("seq")).first()[0]) / 2)
    return log.layered(rows.where(F.col("seq") >= half), rows.where(F.col("seq") < half)).select(key_text(), "seq", "op", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1 AND k >= '12' AND k < '15'")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.scan(events(spark, sf_dir), F.lit(b"12"), F.lit(b"15")).select(key_text(), "seq", "value")


@query(f"WITH {LOG} SELECT k, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM log WHERE value <= 480 AND seq < coalesce((SELECT min(seq) FROM log WHERE value > 480), 9223372036854775807)) WHERE n = 1 AND op = 1")
def replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return log.live(recovery.valid_prefix(rows, F.col("value") <= 480)).select(key_text(), "seq", "value")


@query(
    f"""WITH {LOG}, segs AS (SELECT *, seq // 500 AS segment FROM log), bad AS (SELECT segment, min(seq) AS b FROM segs WHERE value > 300 GROUP BY segment)
SELECT segment, count(*) AS kept FROM segs LEFT JOIN bad USING (segment) WHERE b IS NULL OR seq < b GROUP BY segment"""
)
def replay_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("segment", F.floor(F.col("seq") / 500).cast("long"))
    return recovery.valid_prefix(rows, F.col("value") <= 300, by="segment").groupBy("segment").agg(F.count("*").alias("kept"))


@query(f"WITH {LOG} SELECT seq, op::INT AS op, k FROM log WHERE seq > 900")
def apply_after_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.after(events(spark, sf_dir), 900).select("seq", "op", key_text())


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1")
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return log.live(recovery.replayed(rows, rows)).select(key_text(), "seq", "value")


@query(f"WITH {LOG} SELECT seq // 1000 AS segment, k, max(seq) AS seq, arg_max(op, seq)::INT AS op FROM log GROUP BY seq // 1000, k")
def segment_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.segment_compacted(events(spark, sf_dir), F.floor(F.col("seq") / 1000).cast("long")).select("segment", key_text(), "seq", "op")


@query(f"WITH {LOG} SELECT count(*) AS left_rows, min(seq) AS first_seq FROM log WHERE seq > 700")
def log_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.truncated(events(spark, sf_dir), 700).agg(F.count("*").alias("left_rows"), F.min("seq").alias("first_seq"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def semi_existing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.present(table(spark, sf_dir, "orders"), lines, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.absent(table(spark, sf_dir, "orders"), lines, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.absent(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id").agg(F.count("*").alias("unlabelled"))


@query(
    """WITH held AS (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) AS h FROM orders)
SELECT 11 * count(*) AS asked, count(*) FILTER (WHERE h) AS held, true AS few_others FROM held"""
)
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' keys and ten keys each that nobody holds: none of the held ones is lost, and of the others less than twice the target rate pass."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    asked = orders.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.when(i == 0, F.col("key")).otherwise(-(F.col("key") * 16 + i)))).alias("key"))
    n = max(lines.count(), 1)
    passed = membership.might_hold(asked, "key", membership.bloom(lines, "key", n), n)
    marked = passed.join(lines.withColumn("held", F.lit(True)), "key", "left")
    both = asked.agg(F.count("*").alias("asked")).crossJoin(marked.agg(F.count("*").alias("passed"), F.count("held").alias("held")))  # a row each
    return both.select("asked", "held", (F.col("passed") - F.col("held") <= 0.02 * (F.col("asked") - F.col("held"))).alias("few_others"))
