"""Commands, replication messages and request frames as column expressions: bytes out of columns, columns out of bytes.

All numbers are big-endian, all lengths of 4 bytes. What doesn't hold what its lengths say
is parsed to null; a frame with another mark or version fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DELETE, FLUSH, PUT
from .codecs import big_endian, framed, signed

#: Fixed values of the request frames.
MARK, VERSION = 0x4B56, 1
COMMANDS = {"get": 0x01, "put": 0x02, "delete": 0x03, "batch_get": 0x11, "batch_put": 0x12, "ping": 0x20, "stats": 0x21}
STATUSES = {"ok": 0, "not_found": 1, "error": 2}
MOST_BYTES = 16 * 1024 * 1024


def number(raw: Column, at: Column | int, width: int) -> Column:
    """The whole number in `width` bytes from position `at` on (1 is the first)."""
    return signed(F.substring(raw, at if isinstance(at, Column) else F.lit(at), F.lit(width)))


def part(raw: Column, at: Column | int, size: Column) -> Column:
    """`size` bytes from `at` on; null if there are fewer."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.when((size >= 0) & (F.octet_length(raw) >= at + size - 1), F.substring(raw, at, size.cast("int")))


def command(op: Column, key: Column, value: Column) -> Column:
    """Code, key but for a flush, and a put's value (JSON bytes)."""
    code = big_endian(op, 1)
    json = F.coalesce(value, F.lit(b"null"))
    return F.when(op == FLUSH, code).when(op == DELETE, F.concat(code, framed(key))).when(op == PUT, F.concat(code, framed(key), framed(json)))


def parse_command(raw: Column) -> Column:
    """struct(op, key, value)."""
    op = number(raw, 1, 1).cast("int")
    size = number(raw, 2, 4)
    value = part(raw, (size + 10).cast("int"), number(raw, (size + 6).cast("int"), 4))
    key = part(raw, 6, size)
    made = lambda k, v: F.struct(op.alias("op"), k.alias("key"), v.alias("value"))
    none = F.lit(None).cast("binary")
    return F.when(op == FLUSH, made(none, none)).when((op == DELETE) & key.isNotNull(), made(key, none)).when((op == PUT) & key.isNotNull() & value.isNotNull(), made(key, value))


def get_request(key: Column) -> Column:
    return framed(key)


def parse_get_request(raw: Column) -> Column:
    return part(raw, 5, number(raw, 1, 4))


def get_response(value: Column) -> Column:
    """A found flag, and the value (JSON bytes) where there is one."""
    return F.when(value.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), framed(value)))


def parse_get_response(raw: Column) -> Column:
    """struct(found, value)."""
    found = number(raw, 1, 1) != 0
    return F.struct(found.alias("found"), F.when(found, part(raw, 6, number(raw, 2, 4))).alias("value"))


def replication(seq: Column, op: Column, key: Column, value: Column) -> Column:
    return F.concat(big_endian(seq, 8), big_endian(op, 1), framed(key), framed(value))


def parse_replication(raw: Column) -> Column:
    """struct(seq, op, key, value); an empty value is none."""
    size = number(raw, 10, 4)
    key = part(raw, 14, size)
    value = part(raw, (size + 18).cast("int"), number(raw, (size + 14).cast("int"), 4))
    some = F.when(F.octet_length(value) > 0, value)
    return F.when(key.isNotNull() & value.isNotNull(), F.struct(number(raw, 1, 8).alias("seq"), number(raw, 9, 1).cast("int").alias("op"), key.alias("key"), some.alias("value")))


def head(code: Column, id_: Column) -> Column:
    return F.concat(big_endian(F.lit(MARK), 2), big_endian(F.lit(VERSION), 1), big_endian(code, 1), big_endian(id_, 8))


def bounded(frame: Column) -> Column:
    return F.when(F.octet_length(frame) > MOST_BYTES, F.raise_error(F.lit("a frame of over 16 MB")).cast("binary")).otherwise(frame)


def request(code: Column, id_: Column, key: Column, value: Column) -> Column:
    return bounded(F.concat(head(code, id_), framed(key), framed(value)))


def response(status: Column, id_: Column, body: Column) -> Column:
    return bounded(F.concat(head(status, id_), framed(body)))


def known(raw: Column) -> Column:
    """raw, if its mark and version are these."""
    wrong = F.when(number(raw, 1, 2) != MARK, "not a frame's mark").when(number(raw, 3, 1) != VERSION, "a frame of another version")
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("binary")).otherwise(raw)


def parse_request(raw: Column) -> Column:
    """struct(code, id, key, value); empty ones are none."""
    raw = known(raw)
    size = number(raw, 13, 4)
    key, value = part(raw, 17, size), part(raw, (size + 21).cast("int"), number(raw, (size + 17).cast("int"), 4))
    some = lambda x: F.when(F.octet_length(x) > 0, x)
    return F.when(key.isNotNull() & value.isNotNull(), F.struct(number(raw, 4, 1).cast("int").alias("code"), number(raw, 5, 8).alias("id"), some(key).alias("key"), some(value).alias("value")))


def parse_response(raw: Column) -> Column:
    """struct(status, id, body)."""
    raw = known(raw)
    body = part(raw, 17, number(raw, 13, 4))
    return F.when(body.isNotNull(), F.struct(number(raw, 4, 1).cast("int").alias("status"), number(raw, 5, 8).alias("id"), F.when(F.octet_length(body) > 0, body).alias("body")))
