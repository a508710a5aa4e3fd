"""Counters, histograms, gauges, acknowledgements and liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import log, metrics
from .inputs import LOG, NEWEST, events, table

EDGES = "edges AS (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 1000, 'infinity'::DOUBLE]) AS le)"
BUCKETS = EDGES + ", c AS (SELECT (SELECT min(le) FROM edges WHERE value <= le) AS le, count(*) AS n FROM events GROUP BY 1), b AS (SELECT e.le, coalesce(n, 0)::BIGINT AS n FROM edges e LEFT JOIN c ON c.le = e.le)"


@query(f"WITH {LOG} SELECT count(*) FILTER (WHERE op = 1) AS put_total, count(*) FILTER (WHERE op = 2) AS delete_total, count(*) AS append_total FROM log")
def op_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(events(spark, sf_dir))


@query(f"WITH {BUCKETS} SELECT le, n FROM b")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events").select("value"), F.col("value"))


@query(f"WITH {BUCKETS} SELECT le, sum(n) OVER (ORDER BY le)::BIGINT AS n FROM b")
def latency_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cumulative(metrics.histogram(table(spark, sf_dir, "events").select("value"), F.col("value")))


HISTOGRAM = """r AS (SELECT le, sum(n) OVER (ORDER BY le)::BIGINT AS n FROM b)
SELECT '# HELP get_latency_ms Time of a read.' AS line UNION ALL SELECT '# TYPE get_latency_ms histogram'
UNION ALL SELECT 'get_latency_ms_bucket{le="' || CASE WHEN isinf(le) THEN '+Inf' ELSE le::BIGINT::VARCHAR END || '"} ' || n::VARCHAR FROM r
UNION ALL SELECT 'get_latency_ms_count ' || sum(n)::BIGINT::VARCHAR FROM b
UNION ALL SELECT 'get_latency_ms_sum ' || (SELECT sum(floor(value))::BIGINT FROM events)::VARCHAR"""


def scalar(name: str, about: str, kind: str, value: str) -> str:
    return f"SELECT '# HELP {name} {about}' AS line UNION ALL SELECT '# TYPE {name} {kind}' UNION ALL SELECT '{name} ' || ({value})::VARCHAR"


@query(f"WITH {BUCKETS}, {HISTOGRAM}")
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exposition(table(spark, sf_dir, "events").select("value"), F.col("value"), "get_latency_ms")


@query(
    f"""WITH {BUCKETS}, {HISTOGRAM} UNION ALL
{scalar("put_total", "Puts.", "counter", "SELECT count(*) FROM events WHERE event_type <> 'error'")} UNION ALL
{scalar("delete_total", "Deletes.", "counter", "SELECT count(*) FROM events WHERE event_type = 'error'")} UNION ALL
{scalar("wal_append_total", "Log entries.", "counter", "SELECT count(*) FROM events")} UNION ALL
{scalar("sorted_files", "Runs of all levels.", "gauge", "SELECT count(DISTINCT event_id // 1000) FROM events")}"""
)
def metrics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole page: a histogram, counters and a gauge, with what each is."""
    rows = events(spark, sf_dir)
    counts = metrics.counters(rows).withColumnRenamed("append_total", "wal_append_total")
    files = rows.agg(F.count_distinct(F.floor(F.col("seq") / 1000)).alias("sorted_files"))
    return metrics_text(spark, sf_dir).unionByName(metrics.scalars(counts, "counter")).unionByName(metrics.scalars(files, "gauge"))


@query(f"WITH {LOG}, {NEWEST} SELECT sum(CASE WHEN op = 2 THEN length(k) + 16 ELSE length(k) + length(props) + 32 END)::BIGINT AS memtable_active_bytes, count(*) AS entries FROM newest")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.latest(events(spark, sf_dir, "props"))
    return rows.agg(F.sum(log.entry_bytes(F.encode("props", "UTF-8"))).alias("memtable_active_bytes"), F.count("*").alias("entries"))


@query("WITH l AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) SELECT user_id, floor((epoch_us((SELECT max(t) FROM l)) - epoch_us(t)) / 1000000.0)::BIGINT AS gap_s, floor((epoch_us((SELECT max(t) FROM l)) - epoch_us(t)) / 1000000.0) <= 3600 AS alive FROM l")
def liveness_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.liveness(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 3600)


@query("SELECT event_id // 100 AS batch, count(*) FILTER (WHERE event_type <> 'error') AS acks, count(*) AS sent FROM events GROUP BY event_id // 100")
def ack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).cast("long").alias("batch"), "event_type")
    return metrics.acknowledged(rows, "batch", F.col("event_type") != "error")
