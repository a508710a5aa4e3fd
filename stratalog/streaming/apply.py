"""Logs as streams: runs written by micro-batch, and running views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import DELETE, FLUSH, PUT, op_code
from ..operators.log import latest
from ..store import Store


def log_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def write_runs(log: DataFrame, out: str, checkpoint: str, available_now: bool = True, every: str = "1 second") -> StreamingQuery:
    """One sorted run a micro-batch. A run's path follows from the batch's number and is overwritten, so a repeated batch changes nothing."""

    def flush(batch: DataFrame, number: int) -> None:
        latest(batch).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{out}/run_id={number}")

    writer = log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def apply_each(log: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch, newest rows only, to a callback."""
    return log.writeStream.foreachBatch(lambda batch, n: callback(latest(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_commands(log: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Applies a stream of (seq, op, key, value) to a store in offset order: puts and deletes, and a flush where its batch holds one.

    A repeated batch changes nothing: entries carry their seq, and the newest of a key wins. An unknown op fails the batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select("seq", op_code(F.col("op")).alias("op"), "key", "value").persist()
        try:
            for op, use in ((PUT, store.put), (DELETE, lambda r: store.delete(r.select("seq", "key")))):
                some = rows.where(F.col("op") == op).drop("op")
                if not some.isEmpty():
                    use(some)
            if not rows.where(F.col("op") == FLUSH).isEmpty():
                store.flush()
        finally:
            rows.unpersist()

    return log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latest(log: DataFrame) -> DataFrame:
    """Newest values of each key, for complete or update mode; each key is a row of state."""
    rest = [c for c in log.columns if c not in ("key", "seq")]
    return log.groupBy("key").agg(F.max("seq").alias("seq"), *(F.max_by(c, "seq").alias(c) for c in rest))


def once(log: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows of which each seq counts once, with state for no longer than rows may be late."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(["seq"])


def op_rates(log: DataFrame, ts: str, window: str, late: str) -> DataFrame:
    """Operations by window and op; late rows beyond the watermark don't count."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), "op").agg(F.count("*").alias("n"))
