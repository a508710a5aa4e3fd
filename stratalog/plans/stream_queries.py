"""The log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..model import shared_folder
from ..operators import log
from ..streaming import apply
from .inputs import LOG, NEWEST, events, key_text

def _stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The events log in four files, as a stream."""
    rows, to = events(spark, sf_dir, *columns), shared_folder(spark)
    rows.repartitionByRange(4, "seq").write.parquet(to)
    return apply.log_stream(spark, to, rows.schema)


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch writes a sorted run; the runs together are the log."""
    out = shared_folder(spark)
    apply.write_runs(_stream(spark, sf_dir), out, shared_folder(spark)).awaitTermination()
    return log.live(spark.read.parquet(out).drop("run_id")).select(key_text(), "seq", "value")


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-mode newest values; each batch's view replaces the last one's."""
    out = shared_folder(spark)
    view = apply.running_latest(_stream(spark, sf_dir))
    writer = view.writeStream.outputMode("complete").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).where("op = 1").select(key_text(), "seq", "value")


@query(f"WITH {LOG} SELECT seq, op::INT AS op, k FROM log")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log delivered twice; each seq is applied once."""
    out = shared_folder(spark)
    rows = _stream(spark, sf_dir, "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = apply.once(rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), "ts", "30 days")
    twice.select("seq", "op", "key").writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("seq", "op", key_text())
