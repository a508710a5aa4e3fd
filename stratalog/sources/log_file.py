"""Write-ahead log files.

A file starts with a 4-byte mark, then come records {checksum, op, key length, key, value
length, value}, big-endian; the checksum covers what follows it. Files without the mark
are of an older kind: records without a checksum. Reading stops at a file's first record
that is cut off or damaged.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import log_record
from ..shipping import ship
from .sorted_file import files

MARK = struct.pack(">i", 0x4B564442)


def record(op: int, key: bytes, value: bytes | None) -> bytes:
    value = value or b""
    body = struct.pack(">bi", op, len(key)) + key + struct.pack(">i", len(value)) + value
    return struct.pack(">I", zlib.crc32(body)) + body


def parse(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(position, op, key, value) of each record before the first bad one; a delete has no value."""
    checked = raw.startswith(MARK)
    at = len(MARK) if checked else 0
    n = 0
    while at < len(raw):
        head = at + 4 if checked else at
        try:
            op, size = struct.unpack_from(">bi", raw, head)
            (length,) = struct.unpack_from(">i", raw, head + 5 + size)
        except struct.error:
            return
        end = head + 9 + size + length
        if min(size, length) < 0 or end > len(raw) or op not in (1, 2):
            return
        if checked and struct.unpack_from(">I", raw, at)[0] != zlib.crc32(raw[head:end]):
            return
        yield n, op, raw[head + 5 : head + 5 + size], raw[end - length : end] if op == 1 else None
        n, at = n + 1, end


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, position, op, key, value) of the files' valid prefixes; a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int8(), pa.binary(), pa.binary())
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := [(name, *r) for r in parse(raw)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "position", "op", "key", "value"])

    ship(spark)
    return files(spark, path, pattern).select("path", "content").mapInArrow(run, "path string, position long, op tinyint, key binary, value binary")


def contents(log: DataFrame, by: str, order: str = "seq") -> DataFrame:
    """(by, content): the log file of each segment; a segment is a file and is built in one task.

    Records are joined as text of one byte a character, in one go: no record copies those before it.
    """
    record = F.decode(log_record(F.col("op"), F.col("key"), F.col("value")), "ISO-8859-1")
    records = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), record.alias("r"))))
    joined = F.array_join(F.transform(records, lambda x: x["r"]), "")
    return log.groupBy(by).agg(F.concat(F.lit(bytearray(MARK)), F.encode(joined, "ISO-8859-1")).alias("content"))
