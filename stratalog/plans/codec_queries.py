"""Codecs and byte functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import codecs, messages
from .inputs import events, table


@query("SELECT doc_id, text, strlen(text)::BIGINT AS bytes FROM documents")
def codec_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", codecs.utf8(F.col("text")).alias("raw"))
    return raw.select("doc_id", codecs.text(F.col("raw")).alias("text"), F.octet_length("raw").cast("long").alias("bytes"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS n FROM events")
def codec_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", codecs.from_json(codecs.utf8(F.col("props")), "k bigint")["k"].alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS n FROM events")
def codec_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(codecs.variant(codecs.utf8(F.col("props"))), "$.k", "bigint").alias("n"))


@query("SELECT o_orderkey, lower(printf('%016X', o_orderkey)) AS packed, o_orderkey AS unpacked FROM orders")
def codec_longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select("o_orderkey", codecs.big_endian(F.col("o_orderkey"), 8).alias("raw"))
    return raw.select("o_orderkey", F.lower(F.hex("raw")).alias("packed"), codecs.signed(F.col("raw")).alias("unpacked"))


@query("SELECT event_id, (13 + length(user_id::VARCHAR) + length(props))::BIGINT AS bytes FROM events")
def log_record_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "props")
    return rows.select(F.col("seq").alias("event_id"), F.octet_length(codecs.log_record(F.col("op"), F.col("key"), codecs.utf8(F.col("props")))).cast("long").alias("bytes"))


@query("SELECT event_id, coalesce(value::BIGINT::VARCHAR, 'null') AS shown FROM (SELECT event_id, floor(value) AS value FROM events)")
def values_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", codecs.rendered(F.floor("value").cast("long")).alias("shown"))


@query("SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (h * 31 + b) % 4294967296) AS h FROM nation")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", codecs.polynomial_hash(codecs.utf8(F.col("n_name"))).alias("h"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, user_id::VARCHAR AS k, CASE WHEN event_type <> 'error' THEN (props->>'$.k')::BIGINT END AS n,
(5 + length(user_id::VARCHAR) + CASE WHEN event_type <> 'error' THEN 4 + length('{"k":' || (props->>'$.k') || '}') ELSE 0 END)::BIGINT AS bytes FROM events"""
)
def codec_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands written as bytes and parsed again; values are JSON."""
    rows = events(spark, sf_dir, "props")
    value = codecs.as_json(codecs.from_json(codecs.utf8(F.col("props")), "k bigint"))
    raw = rows.select("seq", messages.command(F.col("op"), F.col("key"), value).alias("raw"))
    back = raw.select("seq", messages.parse_command(F.col("raw")).alias("c"), F.octet_length("raw").cast("long").alias("bytes"))
    return back.select(F.col("seq").alias("event_id"), F.col("c.op").alias("op"), codecs.text(F.col("c.key")).alias("k"), codecs.from_json(F.col("c.value"), "k bigint")["k"].alias("n"), "bytes")


@query("SELECT o_orderkey AS seq, 1 AS op, o_custkey::VARCHAR AS k, nullif(o_orderpriority, '') AS v, (17 + length(o_custkey::VARCHAR) + length(o_orderpriority))::BIGINT AS bytes FROM orders")
def codec_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replication messages written as bytes and parsed again."""
    rows = table(spark, sf_dir, "orders")
    raw = rows.select(messages.replication(F.col("o_orderkey"), F.lit(1), codecs.utf8(F.col("o_custkey").cast("string")), codecs.utf8(F.col("o_orderpriority"))).alias("raw"))
    back = raw.select(messages.parse_replication(F.col("raw")).alias("m"), F.octet_length("raw").cast("long").alias("bytes"))
    return back.select("m.seq", "m.op", codecs.text(F.col("m.key")).alias("k"), codecs.text(F.col("m.value")).alias("v"), "bytes")


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 3 ELSE 2 END AS code, user_id::VARCHAR AS k, props AS v, 0 AS status FROM events")
def codec_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request frames and their answers, written as bytes and parsed again."""
    rows = events(spark, sf_dir, "props")
    raw = rows.select(messages.request(F.col("op") + 1, F.col("seq"), F.col("key"), codecs.utf8(F.col("props"))).alias("raw"))
    asked = raw.select(messages.parse_request(F.col("raw")).alias("q"))
    answered = asked.select("q", messages.parse_response(messages.response(F.lit(messages.STATUSES["ok"]), F.col("q.id"), F.col("q.value"))).alias("a"))
    return answered.select("a.id", "q.code", codecs.text(F.col("q.key")).alias("k"), codecs.text(F.col("a.body")).alias("v"), "a.status")
