"""Binary files of the key-value format, read and written where the data is.

Sorted file (big-endian): entries {key length, key, value length, value}, an index
{count, {key length, key, offset (8 bytes)}}, and the index's offset in the last 8 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def dump(entries: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted file's bytes; entries come in key order."""
    out, index = bytearray(), bytearray(struct.pack(">i", len(entries)))
    for key, value in entries:
        index += struct.pack(">i", len(key)) + key + struct.pack(">q", len(out))
        out += struct.pack(">i", len(key)) + key + struct.pack(">i", len(value)) + value
    return bytes(out + index + struct.pack(">q", len(out)))


def parse(raw: bytes) -> list[tuple[bytes, bytes]]:
    """All entries by way of the index; a malformed file raises ValueError."""
    if len(raw) < 8:
        raise ValueError("shorter than a footer")
    (at,) = struct.unpack_from(">q", raw, len(raw) - 8)
    if not 0 <= at <= len(raw) - 12:
        raise ValueError("index out of bounds")
    try:
        (count,) = struct.unpack_from(">i", raw, at)
        at, out = at + 4, []
        for _ in range(count):
            (n,) = struct.unpack_from(">i", raw, at)
            key = raw[at + 4 : at + 4 + n]
            (offset,) = struct.unpack_from(">q", raw, at + 4 + n)
            at += 12 + n
            (k,) = struct.unpack_from(">i", raw, offset)
            (v,) = struct.unpack_from(">i", raw, offset + 4 + k)
            value = raw[offset + 8 + k : offset + 8 + k + v]
            if raw[offset + 4 : offset + 4 + k] != key or len(value) != v:
                raise ValueError("index and data disagree")
            out.append((key, value))
    except struct.error as e:
        raise ValueError("truncated") from e
    return out


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read(spark: SparkSession, path: str, pattern: str = "*.sst") -> DataFrame:
    """(path, key, value, intact): one row an entry; a malformed file gives one row that isn't intact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, k, v, True) for k, v in parse(raw)]
                except ValueError:
                    rows = [(name, None, None, False)]
                if rows:
                    kinds = (pa.string(), pa.binary(), pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "key", "value", "intact"])

    ship(spark)
    return files(spark, path, pattern).select("path", "content").mapInArrow(run, "path string, key binary, value binary, intact boolean")


def checked(made: DataFrame) -> DataFrame:
    """(path, intact) of (path, content): a file is intact if its index and all its entries can be read."""
    kind = made.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for raw in batch.column(1).to_pylist():
                try:
                    parse(raw)
                    good.append(True)
                except ValueError:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good)], names=["path", "intact"])

    ship(made.sparkSession)
    return made.select("path", "content").mapInArrow(run, f"path {kind}, intact boolean")


def contents(rows: DataFrame, by: str) -> DataFrame:
    """(by, content): the sorted file of each group of (by, key, value); a group is a file and is built in one task."""

    def build(group: pa.Table) -> pa.Table:
        entries = sorted(zip(group.column("key").to_pylist(), (v or b"" for v in group.column("value").to_pylist()), strict=True))
        return pa.table({by: group.column(by)[:1], "content": pa.array([dump(entries)], pa.binary())})

    ship(rows.sparkSession)
    return rows.select(by, "key", "value").groupBy(by).applyInArrow(build, f"{by} {rows.schema[by].dataType.simpleString()}, content binary")


def heads(made: DataFrame) -> DataFrame:
    """(path, size, index_offset, entries) of (path, size, content), from each file's last bytes and its index's head.

    Bytes are cut by `substring`; Spark's `right` would take the file for text and count characters.
    """
    offset = F.when(F.col("size") >= 8, F.conv(F.hex(F.substring("content", -8, 8)), 16, -10).cast("long"))
    some = made.withColumn("index_offset", offset)
    count = F.when(F.col("index_offset").between(0, F.col("size") - 12), F.conv(F.hex(F.expr("substring(content, cast(index_offset + 1 as int), 4)")), 16, 10).cast("long"))
    return some.select("path", "size", "index_offset", count.alias("entries"))


def footers(spark: SparkSession, path: str, pattern: str = "*.sst") -> DataFrame:
    """(path, size, index_offset, entries) of a folder's files."""
    return heads(files(spark, path, pattern).select("path", F.col("length").alias("size"), "content"))
