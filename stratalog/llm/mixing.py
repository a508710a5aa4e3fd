"""Mixing sources to target weights, by DataFrame operations only.

Sources by code point (null last) weigh 1, 2, 3, repeating, and share all words of
the corpus; a target stops at EPOCHS times its source's words, and the excess is
shared again by weight. Documents get hash-random keys, of doc_id and text, so rows that
share a doc_id don't share a key; a source's are dealt by key range into buckets, whose word totals are summed up in order, so only the bucket
that holds the cut is sorted. A source gives whole epochs, then its documents in key
order up to the exact budget; the document at the cut gives its first words.

Null text has size 0 and gives nothing. A null doc_id or text counts as empty in the
key. Rows that agree in doc_id and text are interchangeable. An empty table gives none. A column named like a
result is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

EPOCHS = 3
WEIGHTS = 3
#: Documents a bucket, about; a source's documents of one bucket are sorted in one task.
BUCKET = 20_000


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with target: one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1)
    ratio = F.col("source_size") / F.col("weight")
    below = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everyone) - F.coalesce(epochs * F.sum("source_size").over(below), F.lit(0))
    weights = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    # a unit of weight's share if all sources with a smaller ratio are at their limit
    shares = weighed.withColumn("share", left.cast("double") / weights)
    free = F.when(F.col("source_size") * epochs >= F.col("share") * F.col("weight"), F.struct(ratio, F.col("source").isNull(), "source", "share"))
    share = F.min(free).over(everyone).getField("share")
    return shares.withColumn("target", F.least(F.col("source_size") * F.lit(float(epochs)), share * F.col("weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = "") -> DataFrame:
    """docs with size, source_size, target (both of the source) and taken (words, repeats counted)."""
    docs = docs.drop("size", "source_size", "target", "taken")
    bits = min(28, max(4, (docs.count() // BUCKET).bit_length()))
    empty = F.lit("")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), empty), F.lit(":"), F.coalesce("text", empty), F.lit(seed)).cast("binary"))
    bucket = F.shiftright(F.conv(F.substring("__key", 1, 7), 16, 10).cast("int"), 28 - bits)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.withColumn("__key", key).withColumn("__bucket", bucket).withColumn("size", size)
    totals = stored(keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("words")), "mixing")
    goals = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), epochs)
    budget = F.floor("target").cast("long")
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(0))
    goals = goals.withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    ranges = totals.withColumn("before", before).withColumnRenamed("source", "of").withColumnRenamed("__bucket", "edge")
    cut = goals.join(ranges, F.col("source").eqNullSafe(F.col("of")) & F.col("rest").between(F.col("before"), F.col("before") + F.col("words") - 1), "left")
    names = {c: f"__{c}" for c in ("whole", "rest", "edge", "before")}
    cut = stored(cut.select(F.col("source").alias("__source"), "source_size", "target", "whole", "rest", "edge", "before").withColumnsRenamed(names), "mixing-cuts")
    joined = keyed.join(cut, F.col("source").eqNullSafe(F.col("__source")))
    at_edge = F.col("__bucket").eqNullSafe(F.col("__edge"))
    inner = joined.where(~at_edge).withColumn("taken", F.col("size") * (F.col("__whole") + F.when(F.col("__bucket") < F.col("__edge"), 1).otherwise(0)))
    order = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("__rest") - F.col("__before") - (F.sum("size").over(order) - F.col("size"))
    outer = joined.where(at_edge).withColumn("taken", F.col("size") * F.col("__whole") + F.greatest(F.lit(0), F.least(F.col("size"), room)))
    return inner.unionByName(outer).select(*docs.columns, "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def taken_documents(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mix as documents: one row for each time that a document is taken; at the cut, its first words."""
    keep = docs.columns
    named = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("size", "source_size", "target", "taken") if c in keep})
    mixed = mix(named, epochs).where("taken > 0")
    rows = mixed.withColumn("__nth", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    left = F.col("taken") - (F.col("__nth") - 1) * F.col("size")
    first = F.expr(r"regexp_extract(text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', cast(__left as string), '}+'), 0)")
    rows = rows.withColumn("__left", left).withColumn("text", F.when(F.col("__left") >= F.col("size"), F.col("text")).otherwise(first))
    if "n_chars" in keep:
        rows = rows.withColumn("n_chars", F.when(F.col("__left") >= F.col("size"), F.col("n_chars")).otherwise(F.length("text")))
    rows = rows.drop("size", "source_size", "target", "taken")
    return rows.withColumnsRenamed({f"__own_{c}": c for c in keep}).select(*keep)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS share
  FROM weighed WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * (SELECT share FROM shares WHERE 3 * source_size >= share * weight
    ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1)) AS target FROM shares),
cuts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.whole, floor(c.target)::BIGINT - c.whole * c.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""
