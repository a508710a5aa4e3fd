"""Round trips through the binary formats, parquet runs and the store facade."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..catalog import query
from ..functions.codecs import text, utf8
from ..model import shared_folder
from ..operators import log, runs, snapshots
from ..shipping import ship
from ..sources import log_file, sorted_file
from ..store import Store
from .inputs import LOG, NEWEST, RUNS, event_runs, events


def _live_files(spark: SparkSession, made: DataFrame, parse: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows parsed from built files, without a listing between them."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := [(at, *r) for r in parse(raw)]:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    names = kinds.names
    return made.mapInArrow(run, schema)


@query(f"WITH {LOG} SELECT seq // 1000 AS segment, k, max(seq) AS last FROM log GROUP BY seq // 1000, k")
def log_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as log files and read again; the value holds the seq."""
    rows = events(spark, sf_dir).withColumn("segment", F.floor(F.col("seq") / 1000).cast("long")).withColumn("op", F.lit(1)).withColumn("value", utf8(F.col("seq").cast("string")))
    made = log_file.contents(rows, "segment")
    back = _live_files(spark, made, log_file.parse, "segment long, position long, op int, key binary, value binary")
    return back.groupBy("segment", text(F.col("key")).alias("k")).agg(F.max(text(F.col("value")).cast("long")).alias("last"))


@query(f"WITH {LOG}, {RUNS} SELECT run_id, k, seq FROM runs")
def sorted_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_runs(spark, sf_dir).select("run_id", "key", utf8(F.col("seq").cast("string")).alias("value"))
    back = _live_files(spark, sorted_file.contents(rows, "run_id"), sorted_file.parse, "run_id long, key binary, value binary")
    return back.select("run_id", text(F.col("key")).alias("k"), text(F.col("value")).cast("long").alias("seq"))


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value FROM newest WHERE op = 1")
def runs_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sorted parquet runs with a Bloom filter on the key, read together."""
    rows, to = events(spark, sf_dir), shared_folder(spark)
    for i in range(3):
        runs.write(log.latest(rows.where(F.col("seq") % 3 == i)), f"{to}/{i}", files=2, distinct=1000)
    back = runs.read(spark, [f"{to}/{i}" for i in range(3)], rows._jdf.schema().toDDL())
    return log.live(back).select(text(F.col("key")).alias("k"), "seq", "value")


@query("SELECT 6::BIGINT AS total_files, 0::BIGINT AS corrupted_files, count(DISTINCT user_id) AS keys FROM events")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's manifest from its files, all of them intact."""
    to = shared_folder(spark)
    runs.write(log.latest(events(spark, sf_dir)), to, files=6)
    listed = runs.files(spark, to)
    return listed.agg(F.count("*").alias("total_files"), F.count_if(F.col("entries") <= 0).alias("corrupted_files"), F.sum("entries").alias("keys"))


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value::BIGINT AS value FROM (SELECT k, seq, floor(value) AS value FROM newest WHERE op = 1)")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and deletes over five flushes and a compaction, through the facade."""
    store = Store(spark, shared_folder(spark))
    rows = events(spark, sf_dir).withColumn("value", utf8(F.floor("value").cast("long").cast("string")))
    for i in range(5):
        part = rows.where(F.pmod(F.floor(F.col("seq") / 100), F.lit(5)) == i)
        store.put(part.where("op = 1").drop("op"))
        store.delete(part.where("op = 2").select("seq", "key"))
        store.flush()
    store.compact()
    return store.live().select(text(F.col("key")).alias("k"), "seq", text(F.col("value")).cast("long").alias("value"))


@query(f"WITH {LOG}, {NEWEST} SELECT count(*) AS total_files, 0::BIGINT AS corrupted_files FROM (SELECT DISTINCT seq // 1000 FROM log)")
def sorted_files_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural check, on sorted files' footers."""
    rows = event_runs(spark, sf_dir).select("run_id", "key", F.lit(b"x").alias("value"))
    made = sorted_file.contents(rows, "run_id").select(F.col("run_id").cast("string").alias("path"), F.octet_length("content").cast("long").alias("size"), "content")
    return snapshots.summary(snapshots.structural(sorted_file.heads(made)))


@query(f"WITH {LOG}, {NEWEST} SELECT k, seq, value::BIGINT AS value FROM (SELECT k, seq, floor(value) AS value FROM newest WHERE op = 1)")
def store_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half is flushed, half only logged, then the writer is gone: a store opened on the folder holds all of it."""
    folder = shared_folder(spark)
    rows = events(spark, sf_dir).withColumn("value", utf8(F.floor("value").cast("long").cast("string")))
    half = F.lit(rows.agg(F.max("seq")).first()[0] or 0) / 2
    store = Store(spark, folder)
    for part, flushed in ((rows.where(F.col("seq") < half), True), (rows.where(F.col("seq") >= half), False)):
        store.put(part.where("op = 1").drop("op"))
        store.delete(part.where("op = 2").select("seq", "key"))
        if flushed:
            store.flush()
    del store
    return Store(spark, folder).live().select(text(F.col("key")).alias("k"), "seq", text(F.col("value")).cast("long").alias("value"))


@query(f"WITH {LOG}, {NEWEST} SELECT c_custkey::VARCHAR AS k, seq, value::BIGINT AS value FROM customer LEFT JOIN (SELECT k, seq, floor(value) AS value FROM newest WHERE op = 1) ON k = c_custkey::VARCHAR")
def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers looked up in a store of two runs and a log."""
    store = Store(spark, shared_folder(spark))
    rows = events(spark, sf_dir).withColumn("value", utf8(F.floor("value").cast("long").cast("string")))
    for i in range(3):
        part = rows.where(F.col("seq") % 3 == i)
        store.put(part.where("op = 1").drop("op"))
        store.delete(part.where("op = 2").select("seq", "key"))
        if i < 2:
            store.flush()
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(utf8(F.col("c_custkey").cast("string")).alias("key"))
    return store.multi_get(keys).select(text(F.col("key")).alias("k"), "seq", text(F.col("value")).cast("long").alias("value"))


@query(
    f"""WITH {LOG}, parts AS (SELECT *, seq % 3 AS part FROM log), runs AS (SELECT part, k, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(floor(value)::BIGINT::VARCHAR, seq) AS v FROM parts GROUP BY part, k)
SELECT 3::BIGINT AS total_files, sum(8 + length(k) + CASE WHEN op = 1 THEN length(v) ELSE 0 END)::BIGINT AS total_bytes, count(*) AS entries, max(seq) AS last_seq,
(SELECT count(*) FROM (SELECT k, arg_max(op, seq) AS op FROM log GROUP BY k) WHERE op = 1) AS live FROM runs"""
)
def store_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs and a log copied to a snapshot, which is opened as a store of its own.

    Each third is one batch, so it is one run whether it is flushed here or by the store, whose memory it may outgrow.
    """
    store = Store(spark, shared_folder(spark))
    rows = events(spark, sf_dir).withColumn("value", utf8(F.floor("value").cast("long").cast("string")))
    for i in range(3):
        store.apply(rows.where(F.col("seq") % 3 == i))
        if i < 2:
            store.flush()
    info = store.backup("first")
    copy = Store(spark, f"{store.path}/snapshots/first")
    numbers = [F.lit(info[c]).cast("long").alias(c) for c in ("total_files", "total_bytes", "entries", "last_seq")]
    return copy.live().agg(F.count("*").alias("live")).select(*numbers, "live")
