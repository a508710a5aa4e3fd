"""Newest versions, tombstones, lookups and replay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratalog.model import LOG, Settings, checked, op_code, thresholds
from stratalog.operators import compaction, log, membership, metrics, recovery, runs, snapshots

A, B, C = b"a", b"b", b"c"


def made(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def pairs(df):
    return sorted((bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in df.collect())


def test_overwrite_and_delete(spark):
    rows = made(spark, (1, 1, A, b"1"), (2, 1, A, b"2"), (3, 1, B, b"x"), (4, 2, B, None), (5, 2, C, None))
    assert pairs(log.live(rows)) == [(A, b"2")]
    assert pairs(log.latest(rows)) == [(A, b"2"), (B, None), (C, None)]


def test_tombstone_older_than_a_put_hides_nothing(spark):
    assert pairs(log.live(made(spark, (1, 2, A, None), (2, 1, A, b"1")))) == [(A, b"1")]


def test_empty_and_missing_values_differ(spark):
    assert pairs(log.live(made(spark, (1, 1, A, b""), (2, 1, B, None)))) == [(A, b""), (B, None)]


def test_byte_order(spark):
    keys = [b"\x01\x02\x03", b"\x01\x02", b"", b"\x80", b"\x7f", b"\x7f\x00", b"\xff", "键".encode()]
    rows = log.scan(made(spark, *((i, 1, k, b"v") for i, k in enumerate(keys))))
    assert [bytes(r["key"]) for r in rows.collect()] == sorted(keys)


def test_fixed_width_values_keep_a_null_winner(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1.0), (2, 1, "a", None)], "seq long, op int, key string, value double")
    assert log.latest(rows).first()["value"] is None


def test_multi_get_keeps_missing_and_repeated_keys(spark):
    keys = spark.createDataFrame([(A,), (A,), (C,)], "key binary")
    assert pairs(log.multi_get(made(spark, (1, 1, A, b"1")), keys)) == [(A, b"1"), (A, b"1"), (C, None)]


def test_layers(spark):
    newer, older = made(spark, (1, 1, A, b"new")), made(spark, (9, 1, A, b"old"), (10, 1, B, b"b"))
    assert pairs(log.layered(newer, older)) == [(A, b"new"), (B, b"b")]


def test_filters_reach_the_scan(spark, tmp_path):
    made(spark, (1, 1, A, b"1")).write.parquet(f"{tmp_path}/log")
    plan = log.get(spark.read.parquet(f"{tmp_path}/log"), A)._jdf.queryExecution().toString()
    assert "EqualTo(key" in plan


def test_any_split_of_a_log_gives_the_same_view(spark):
    rows = [(i, 2 if i % 7 == 0 else 1, bytes([i * 37 % 11]), None if i % 7 == 0 else str(i).encode()) for i in range(300)]
    whole = made(spark, *rows)
    split = runs.split(whole, F.floor(F.col("seq") / 40).cast("long"), F.when(F.col("seq") < 120, 1).otherwise(0))
    merged = compaction.compact(split, runs.zone_map(split), 0, 99)
    assert pairs(log.live(merged)) == pairs(log.live(whole))


def test_replay_stops_at_the_first_damaged_row(spark):
    rows = made(spark, (1, 1, A, b"1"), (2, 1, A, b"bad"), (3, 1, A, b"3"))
    assert pairs(recovery.valid_prefix(rows, F.col("value") != b"bad")) == [(A, b"1")]
    assert recovery.valid_prefix(rows, F.lit(True)).count() == 3
    assert recovery.valid_prefix(rows.where("false"), F.lit(True)).count() == 0


def test_replay_twice(spark):
    rows = made(spark, (1, 1, A, b"1"), (2, 2, A, None), (3, 1, B, b"b"))
    assert pairs(log.live(recovery.replayed(rows, rows, rows))) == [(B, b"b")]
    assert recovery.after(rows, 2).count() == 1


def test_rejected_rows(spark):
    rows = spark.createDataFrame([(1, 1, A), (2, 9, A), (None, 1, A), (4, 1, None), (5, None, A)], "seq long, op int, key binary")
    good, bad = checked(rows)
    assert (good.count(), bad.count()) == (1, 4)
    for some, said in ((rows.where("op = 9"), "unknown op 9"), (rows.where("op IS NULL"), "unknown op null")):
        with pytest.raises(Exception, match=said):
            some.select(op_code(F.col("op"))).collect()
    assert rows.where("op = 1").select(op_code(F.col("op"))).count() == 3


def test_sizes(spark):
    rows = made(spark, (1, 1, b"key", b"value"), (2, 2, b"key2", None))
    assert [r[0] for r in rows.orderBy("seq").select(log.entry_bytes()).collect()] == [40, 20]
    full = log.batches_full(made(spark, (1, 1, A, b"x" * 67)), F.lit(0), 100).first()
    assert (full["bytes"], full["full"]) == (100, False)


def test_candidates_and_bounds(spark):
    rows = spark.createDataFrame([(0, 1, A, b"z"), (0, 2, A, b"z"), (1, 3, b"b", b"y"), (1, 4, None, None)], "level int, run_id long, min_key binary, max_key binary")
    found = lambda k: sorted(r["run_id"] for r in runs.candidates(rows, F.lit(k)).collect())
    assert [found(k) for k in (b"a", b"b", b"y", b"z")] == [[1, 2, 4], [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 4]]


def test_compaction_is_due_at_the_threshold(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 10)], "level int, files long")
    assert [r["due"] for r in compaction.due(sizes).orderBy("level").collect()] == [False, True]
    assert thresholds()[0] == 4


def test_tombstones_stay_while_older_runs_lie_below(spark):
    rows = made(spark, (5, 2, A, None), (6, 1, B, b"b"))
    assert compaction.merge(rows).count() == 2
    assert pairs(compaction.merge(rows, bottom=True)) == [(B, b"b")]


def test_bloom_has_no_false_negatives(spark):
    held = spark.range(0, 2000).select(F.col("id").alias("key"))
    asked = spark.range(0, 12_000).select(F.col("id").alias("key"))
    passed = membership.might_hold(asked, "key", membership.bloom(held, "key", 2000), 2000)
    n = passed.count()
    assert passed.where("key < 2000").count() == 2000
    assert (n - 2000) / 10_000 < 0.02
    assert membership.bloom_size(1000)[1] == 7


def test_bloom_of_many_shards_sends_a_row_once(spark):
    """Keys and rows are each sent once, not once a bit; repeated rows stay, null keys don't pass."""
    held = spark.range(0, 50_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    asked = spark.range(0, 250_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 3).alias("shard"), F.lit(1).alias("word"))
    asked = asked.unionByName(asked.where("key = 'k7'")).unionByName(spark.sql("SELECT string(NULL) AS key, 0L AS shard, 1 AS word"))
    assert membership.shards_of(membership.bloom_size(50_000)[0])[0] > 20
    passed = membership.might_hold(asked, "key", membership.bloom(held, "key", 50_000), 50_000)
    assert passed._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 1  # the filter's bits, none of the rows'
    assert passed.columns == asked.columns
    n, true, sevens, nulls = passed.agg(F.count("*"), F.count_if(F.substring("key", 2, 9).cast("long") < 50_000), F.count_if(F.col("key") == "k7"), F.count_if(F.col("key").isNull())).first()
    assert (true, sevens, nulls) == (50_001, 2, 0)
    assert 0.007 < (n - true) / 200_000 < 0.013


def test_histogram(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 5.0, 10.0, 100.0, 1000.0, 5000.0)], "v double")
    n = {r["le"]: r["n"] for r in metrics.histogram(rows, F.col("v")).collect()}
    assert (len(n), n[1.0], n[25.0], n[1000.0], n[float("inf")]) == (10, 1, 0, 1, 1)
    assert metrics.cumulative(metrics.histogram(rows, F.col("v"))).where("le = 1000").first()["n"] == 5
    lines = [r["line"] for r in metrics.exposition(rows, F.col("v"), "x", "Some.").collect()]
    assert lines[:2] == ["# HELP x Some.", "# TYPE x histogram"] and lines[-3:] == ['x_bucket{le="+Inf"} 6', "x_count 6", "x_sum 6116"]
    five = [r["line"] for r in metrics.exposition(rows.where("v <= 1000"), F.col("v"), "x", "Some.").collect()]
    assert five[-2:] == ["x_count 5", "x_sum 1116"]
    assert metrics.exposition(rows.where("false"), F.col("v"), "x", "Some.").collect()[-1]["line"] == "x_sum 0"
    one = spark.createDataFrame([(3, None)], "put_total long, get_total long")
    assert [r["line"] for r in metrics.scalars(one, "counter").collect()][2:] == ["put_total 3", "# HELP get_total Reads.", "# TYPE get_total counter", "get_total 0"]


def test_overlaps_with_missing_bounds(spark):
    """A missing bound matches; each pair comes once, whatever the cuts."""
    rows = [(1, 5, 9), (2, 9, 20), (3, 10, 11), (4, None, 4), (5, 4, None), (6, None, None), (7, 30, 40)]
    some = spark.createDataFrame(rows, "run_id long, min_key int, max_key int")
    meets = lambda a, b: (a[2] is None or b[1] is None or a[2] >= b[1]) and (a[1] is None or b[2] is None or a[1] <= b[2])
    expected = sorted((a[0], b[0]) for a in rows for b in rows if meets(a, b))
    for cuts in (1, 3, 64):
        pairs = compaction.overlap_pairs(some, some, cuts)
        assert sorted(map(tuple, pairs.collect())) == expected
        assert "Join [stretch" in pairs._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_few_rows_are_made_by_many_tasks(spark):
    """Runs of little data that all overlap: no task makes more than a part of the pairs."""
    ranges = spark.range(1000).select(F.col("id").alias("run_id"), F.col("id").alias("min_key"), (5000 + F.col("id")).alias("max_key"))
    by_task = compaction.overlap_pairs(ranges, ranges).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in by_task) == 1_000_000
    assert max(r["n"] for r in by_task) < 100_000


def test_overlaps_are_counted_without_pairs(spark):
    """As many as there are pairs, of ranges that share bounds or miss some."""
    some = random.Random(7)
    rows = [(n, *sorted((some.randrange(60), some.randrange(60)))) for n in range(80)]
    rows += [(100, None, 4), (101, 4, None), (102, None, None), (103, 61, 62), (104, -5, -5)]
    meets = lambda a, b: (a[2] is None or b[1] is None or a[2] >= b[1]) and (a[1] is None or b[2] is None or a[1] <= b[2])
    expected = {a[0]: sum(a != b and meets(a, b) for b in rows) for a in rows}
    ranges = spark.createDataFrame(rows, "run_id long, min_key int, max_key int")
    for cuts in (1, 3, 64):
        assert {r["run_id"]: r["overlaps"] for r in compaction.overlap_counts(ranges, cuts).collect()} == expected


def test_structural_check(spark):
    files = spark.createDataFrame([("good", 100, 50, 3), ("short", 4, None, None), ("beyond", 100, 95, 3), ("many", 100, 50, 10_000_001)], "path string, size long, index_offset long, entries long")
    assert {r["path"]: r["intact"] for r in snapshots.structural(files).collect()} == {"good": True, "short": False, "beyond": False, "many": False}


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"segment_bytes": 5, "other": 1}')
    assert Settings.load(tmp_path / "s.json").segment_bytes == 5
    assert Settings.load(tmp_path / "none.json") == Settings()
    for wrong in ({"file_bytes": 0}, {"durability": "NEVER"}):
        with pytest.raises(ValueError):
            Settings(**wrong)
