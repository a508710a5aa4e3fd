"""Membership: Bloom filters, and exact semi and anti joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shard of a filter: some 1,700 keys at a rate of 0.01, so shards are filled alike.
SHARD = 256


def bloom_size(entries: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions)."""
    if entries <= 0 or not 0 < rate < 1:
        raise ValueError("entries must be positive and the rate between 0 and 1")
    bits = int(-entries * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, math.ceil(bits / entries * math.log(2)))


def shards_of(bits: int) -> tuple[int, int]:
    """(shards, words of each): a filter of at least so many bits in shards of about SHARD words."""
    shards = max(1, round(bits / (64 * SHARD)))
    return shards, -(-bits // (64 * shards))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")


def positions(key: Column, words: int, hashes: int) -> list[Column]:
    """A key's bits in its shard."""
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(64 * words)).cast("int") for i in range(hashes)]


def bit_of(at: Column) -> Column:
    """The place's bit in its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))


def bloom(rows: DataFrame, key: str, entries: int, rate: float = 0.01) -> DataFrame:
    """(shard, word, mask): the set bits, 64 to a row. All bits of a key lie in one shard, where they are summed up, so a key is sent once."""
    bits, hashes = bloom_size(entries, rate)
    shards, words = shards_of(bits)
    keys = rows.where(F.col(key).isNotNull()).select(shard_of(F.col(key), shards).alias("shard"), F.col(key).alias("key")).repartition("shard")
    at = keys.select("shard", F.explode(F.array(*positions(F.col("key"), words, hashes))).alias("at"))
    return at.groupBy("shard", F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit_of(F.col("at"))).alias("mask"))


def might_hold(rows: DataFrame, key: str, made: DataFrame, entries: int, rate: float = 0.01) -> DataFrame:
    """Rows whose key may be in the filter: no false negatives. Each row is sent once, to its shard's words; the filter isn't broadcast."""
    bits, hashes = bloom_size(entries, rate)
    shards, words = shards_of(bits)
    every = rows.sparkSession.range(shards * words).select((F.col("id") / words).cast("int").alias("shard"), (F.col("id") % words).cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    full = made.unionByName(every).groupBy("shard", "word").agg(F.bit_or("mask").alias("mask"))
    filters = full.groupBy(F.col("shard").alias("__shard")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("__masks"))
    asked = rows.where(F.col(key).isNotNull()).withColumn("__shard", shard_of(F.col(key), shards))
    held = reduce(lambda a, b: a & b, (F.get("__masks", F.shiftright(at, 6)).bitwiseAND(bit_of(at)) != 0 for at in positions(F.col(key), words, hashes)))
    return asked.join(filters.hint("shuffle_hash"), "__shard").where(held).select(*rows.columns)


def present(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys, on, "left_semi")


def absent(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys, on, "left_anti")
