"""What the corpus operators share: table access, scratch tables and a few column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word of every contract: code points outside space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that go to a Python worker at once. Spark's own limit of 64 MB is held several times over, on either side.
BATCH, BATCH_KEY = 2_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """From now on rows go to Python workers by BATCH bytes, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at its task's end, freed memory goes back to the system, since workers live on for other tasks."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return through


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one is set where none is (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stratalog-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what `stored` wrote for df; nothing may read it any more."""
    path = df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else None
    if path:
        to = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(to, True)


def parted(df: DataFrame, name: str, size: int) -> DataFrame:
    """df, of columns part and kind, written to the shared folder in at least `size` buckets of part and read again.

    What groups its rows by part then reads each bucket where it lies; only what is joined to them is shuffled.
    """
    spark = df.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    # with fewer buckets than shuffle partitions Spark would deal both sides anew
    buckets = min(100_000, max(size, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    path = f"{scratch_dir(spark)}/{made}"
    df.write.option("compression", "zstd").option("path", path).partitionBy("kind").bucketBy(buckets, "part").saveAsTable(made)
    return spark.table(made)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often a nested lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_ascii(value: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_remainder(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of` (a null doc_id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))
