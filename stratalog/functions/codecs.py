"""Scalar codecs as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def text(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def as_json(value: Column) -> Column:
    return utf8(F.to_json(value))


def from_json(raw: Column, schema: str) -> Column:
    return F.from_json(text(raw), schema)


def variant(raw: Column) -> Column:
    """Untyped JSON; null where it isn't JSON."""
    return F.try_parse_json(text(raw))


def big_endian(number: Column, width: int) -> Column:
    """A whole number as `width` bytes."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * width)))


def signed(raw: Column) -> Column:
    """Four or eight big-endian bytes as a long."""
    wide = F.conv(F.hex(raw), 16, -10).cast("long")
    return F.when((F.octet_length(raw) == 4) & (wide >= 1 << 31), wide - (1 << 32)).otherwise(wide)


def framed(raw: Column) -> Column:
    """Length, then the bytes; null counts as empty."""
    some = F.coalesce(raw, F.lit(b""))
    return F.concat(big_endian(F.octet_length(some), 4), some)


def log_record(op: Column, key: Column, value: Column) -> Column:
    """A log entry: checksum of what follows, op, framed key, framed value."""
    body = F.concat(big_endian(op, 1), framed(key), framed(value))
    return F.concat(big_endian(F.crc32(body), 4), body)


def rendered(value: Column) -> Column:
    """Any value as text; null as `null`."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def polynomial_hash(raw: Column, seed: int = 0) -> Column:
    """31-polynomial over unsigned bytes, as a 32-bit number, disturbed by a seed."""
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.octet_length(raw) > 0, pairs).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, b: (h * 31 + b).bitwiseAND(0xFFFFFFFF))
