"""Operational counters, histograms and gauges over logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DELETE, PUT

EDGES = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
#: What each metric says of itself.
COUNTERS = {
    "put_total": "Puts.", "get_total": "Reads.", "delete_total": "Deletes.", "compaction_total": "Levels merged.", "flush_total": "Runs written from memory.",
    "wal_append_total": "Log entries.", "wal_rotate_total": "Log segments closed.", "wal_crc_failure_total": "Log entries with a wrong checksum.",
}
HISTOGRAMS = {"put_latency_ms": "Time of a put.", "get_latency_ms": "Time of a read.", "compaction_duration_ms": "Time of a merge.", "flush_duration_ms": "Time of a flush."}
GAUGES = {"memtable_active_bytes": "Memory of entries that are added to.", "memtable_immutable_bytes": "Memory of entries that are being flushed.", "sorted_files": "Runs of all levels.", "wal_bytes": "Bytes of the log."}
ABOUT = COUNTERS | HISTOGRAMS | GAUGES


def bucket(value: Column) -> Column:
    """The smallest edge that isn't below the value; infinity beyond the last."""
    out = F.lit(float("inf"))
    for edge in reversed(EDGES):
        out = F.when(value <= edge, float(edge)).otherwise(out)
    return out


def spine(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(array(" + ", ".join(f"{e}D" for e in EDGES) + ", double('infinity'))) AS le")


def histogram(rows: DataFrame, value: Column) -> DataFrame:
    """(le, n) of all ten buckets, empty ones too; not cumulative."""
    counts = rows.where(value.isNotNull()).groupBy(bucket(value).alias("le")).agg(F.count("*").alias("n"))
    return spine(rows.sparkSession).join(counts, "le", "left").select("le", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cumulative(buckets: DataFrame) -> DataFrame:
    """(le, n) with running totals; there are ten rows."""
    upto = F.sum("n").over(Window.orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return buckets.select("le", upto.alias("n"))


def counters(log: DataFrame) -> DataFrame:
    """One row of totals by op."""
    return log.agg(F.count_if(F.col("op") == PUT).alias("put_total"), F.count_if(F.col("op") == DELETE).alias("delete_total"), F.count("*").alias("append_total"))


def exposition(rows: DataFrame, value: Column, name: str, about: str | None = None) -> DataFrame:
    """Text lines of a histogram, in order: what it is, cumulative buckets, count, and sum of whole values."""
    # one pass: counts by edge and their sum come from the same aggregate
    sums = rows.where(value.isNotNull()).groupBy(bucket(value).alias("le")).agg(F.count("*").alias("n"), F.sum(F.floor(value).cast("long")).alias("s"))
    ten = spine(rows.sparkSession).join(sums, "le", "left").select("le", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("s", F.lit(0)).cast("long").alias("s"))
    all_ = ten.agg(F.sort_array(F.collect_list(F.struct("le", "n", "s"))).alias("b"))  # ten entries
    le = lambda x: F.when(x == float("inf"), F.lit("+Inf")).otherwise(x.cast("long").cast("string"))
    total = lambda b, c: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x[c]).cast("string")
    buckets = F.transform("b", lambda x, i: F.concat(F.lit(f'{name}_bucket{{le="'), le(x["le"]), F.lit('"} '), total(F.slice("b", 1, i + 1), "n")))
    before = F.array(F.lit(f"# HELP {name} {about or ABOUT[name]}"), F.lit(f"# TYPE {name} histogram"))
    after = F.array(F.concat(F.lit(f"{name}_count "), total(F.col("b"), "n")), F.concat(F.lit(f"{name}_sum "), total(F.col("b"), "s")))
    return all_.select(F.explode(F.concat(before, buckets, after)).alias("line"))


def scalars(row: DataFrame, kind: str) -> DataFrame:
    """Text lines of one row of counters or gauges, a column each, in order; null is 0."""
    said = lambda c: F.array(F.lit(f"# HELP {c} {ABOUT[c]}"), F.lit(f"# TYPE {c} {kind}"), F.concat(F.lit(f"{c} "), F.coalesce(F.col(c), F.lit(0)).cast("string")))
    return row.select(F.explode(F.concat(*(said(c) for c in row.columns))).alias("line"))


def liveness(beats: DataFrame, node: str, ts: str, limit_s: int) -> DataFrame:
    """(node, gap_s, alive): seconds since a node's last beat, against the newest of all."""
    last = beats.groupBy(node).agg(F.max(ts).cast("timestamp").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    gap = F.unix_micros("newest") - F.unix_micros("last")
    seconds = F.floor(gap / 1_000_000).cast("long")
    return last.crossJoin(F.broadcast(newest)).select(node, seconds.alias("gap_s"), (seconds <= limit_s).alias("alive"))


def acknowledged(acks: DataFrame, batch: str, ok: Column) -> DataFrame:
    return acks.groupBy(batch).agg(F.count_if(ok).alias("acks"), F.count("*").alias("sent"))
