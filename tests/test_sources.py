"""Binary files, codecs, the store and streams."""

from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stratalog.catalog import QUERIES
from stratalog.functions import codecs
from stratalog.model import LOG, Settings
from stratalog.operators import log, runs
import stratalog.plans  # noqa: F401  (registers the queries)
from stratalog.sources import log_file, sorted_file
from stratalog.store import Store
from stratalog.streaming import apply


def found(df, *columns):
    return sorted(tuple(bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns) for r in df.collect())


def test_log_file_stops_at_a_damaged_record(spark, tmp_path):
    records = [log_file.record(1, b"k1", b"v1"), log_file.record(1, b"k2", b"v2"), log_file.record(2, b"k1", None)]
    raw = bytearray(log_file.MARK + b"".join(records))
    (tmp_path / "whole.wal").write_bytes(raw)
    raw[4 + len(records[0])] ^= 1
    (tmp_path / "damaged.wal").write_bytes(raw)
    (tmp_path / "short.wal").write_bytes(log_file.MARK + records[0] + records[1][:-1])
    (tmp_path / "empty.wal").write_bytes(b"")
    rows = log_file.read(spark, str(tmp_path), "*.wal").withColumn("file", F.regexp_extract("path", r"(\w+)\.wal", 1))
    assert found(rows, "file", "position", "op", "key") == [("damaged", 0, 1, b"k1"), ("short", 0, 1, b"k1"), ("whole", 0, 1, b"k1"), ("whole", 1, 1, b"k2"), ("whole", 2, 2, b"k1")]


def test_log_file_of_the_older_kind():
    raw = struct.pack(">bi", 1, 4) + b"leg1" + struct.pack(">i", 4) + b"val1" + struct.pack(">bi", 2, 4) + b"leg2" + struct.pack(">i", 0)
    assert list(log_file.parse(raw)) == [(0, 1, b"leg1", b"val1"), (1, 2, b"leg2", None)]


def test_log_record_as_columns(spark):
    row = spark.createDataFrame([(1, "键".encode(), bytes(range(256)))], "op int, key binary, value binary")
    raw = bytes(row.select(codecs.log_record(F.col("op"), F.col("key"), F.col("value")).alias("r")).first()["r"])
    assert raw == log_file.record(1, "键".encode(), bytes(range(256)))
    assert struct.unpack(">I", raw[:4])[0] == zlib.crc32(raw[4:])


def test_sorted_file_round_trip(spark, tmp_path):
    big = bytes(range(256)) * 4096
    entries = sorted([(b"", b"empty key"), (b"big", big), ("键".encode(), b""), (b"\xff", b"x")])
    (tmp_path / "a.sst").write_bytes(sorted_file.dump(entries))
    (tmp_path / "none.sst").write_bytes(sorted_file.dump([]))
    assert found(sorted_file.read(spark, str(tmp_path)), "key", "value") == entries
    heads = {r["entries"]: r for r in sorted_file.footers(spark, str(tmp_path)).collect()}
    assert set(heads) == {0, 4}


def test_footers_are_bytes_not_text(spark, tmp_path):
    """Offsets that hold bytes above 0x7f, of files beside each other in size."""
    expected = {}
    for n in range(1000, 1064):
        raw = sorted_file.dump([(f"{i:04d}".encode(), b"x" * (n - 999 if i == 0 else 1)) for i in range(1000)])
        (tmp_path / f"{n}.sst").write_bytes(raw)
        expected[n] = (len(raw), struct.unpack(">q", raw[-8:])[0], 1000)
    rows = sorted_file.footers(spark, str(tmp_path)).withColumn("n", F.regexp_extract("path", r"(\d+)\.sst", 1).cast("int"))
    assert {r["n"]: (r["size"], r["index_offset"], r["entries"]) for r in rows.collect()} == expected


@pytest.mark.parametrize("raw", [b"", b"1234567", b"\x7f" * 40, sorted_file.dump([(b"a", b"b")])[:-9] + b"\x00" * 8])
def test_malformed_sorted_files(spark, tmp_path, raw):
    with pytest.raises(ValueError):
        sorted_file.parse(raw)
    (tmp_path / "x.sst").write_bytes(raw)
    assert [r["intact"] for r in sorted_file.read(spark, str(tmp_path)).collect()] == [False] * bool(raw)  # Spark lists no file without bytes


def test_codecs(spark):
    row = spark.createDataFrame([("键 and text", None, 300, -2)], "a string, b string, n long, m int")
    got = row.select(
        codecs.text(codecs.utf8(F.col("a"))).alias("a"), codecs.text(codecs.utf8(F.col("b"))).alias("b"), codecs.signed(codecs.big_endian(F.col("n"), 8)).alias("n"), codecs.signed(codecs.big_endian(F.col("m"), 4)).alias("m"),
        codecs.from_json(codecs.as_json(F.struct("a", "n")), "a string, n long").alias("j"), codecs.rendered(F.col("b")).alias("r"), codecs.variant(codecs.utf8(F.lit("{"))).isNull().alias("v"),
    ).first()
    assert (got["a"], got["b"], got["n"], got["m"], tuple(got["j"]), got["r"], got["v"]) == ("键 and text", None, 300, -2, ("键 and text", 300), "null", True)


def test_runs_have_disjoint_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, f"{i * 7919 % 1000:04d}".encode(), b"v") for i in range(1000)], LOG)
    runs.write(rows, f"{tmp_path}/run", files=4, distinct=1000)
    zones = sorted((bytes(r["min_key"]), bytes(r["max_key"])) for r in runs.files(spark, f"{tmp_path}/run").collect())
    assert len(zones) > 1
    assert all(a[1] < b[0] for a, b in zip(zones, zones[1:], strict=False))


def puts(spark, first, items):
    return spark.createDataFrame([(first + i, k, v) for i, (k, v) in enumerate(items)], "seq long, key binary, value binary")


def live(store):
    return found(store.live(), "key", "value")


def test_store_overwrites_across_flushes_and_levels(spark, tmp_path):
    """The same key written in several runs and levels: the newest wins, a delete hides all older ones."""
    store = Store(spark, str(tmp_path / "store"), Settings(level0_trigger=2))
    for n in range(5):
        store.put(puts(spark, 10 * n, [(b"a", str(n).encode()), (b"b", str(n).encode()), (f"own{n}".encode(), b"x")]))
        store.flush()
        store.compact()
    store.delete(spark.createDataFrame([(100, b"b"), (101, b"missing")], "seq long, key binary"))
    expected = [(b"a", b"4"), *((f"own{n}".encode(), b"x") for n in range(5))]
    assert live(store) == expected  # not flushed yet
    store.flush()
    assert live(Store(spark, str(tmp_path / "store"))) == expected  # opened anew
    store.compact()
    assert live(store) == expected
    assert found(store.get(b"a"), "value") == [(b"4",)] and store.get(b"b").isEmpty()
    asked = spark.createDataFrame([(b"a",), (b"b",)], "key binary")
    assert found(store.multi_get(asked).where("value is not null"), "key", "value") == [(b"a", b"4")]
    at = store.version()
    store.put(puts(spark, 200, [(b"late", b"y")]))
    store.close()
    assert store.snapshot(at).count() == 1 and store.snapshot().count() > 1


def test_store_refuses_null_keys_and_ignores_an_empty_flush(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.flush()
    assert store.version() == -1 and store.live().isEmpty()
    with pytest.raises(ValueError):
        store.put(puts(spark, 0, [(None, b"x")]))
    store.flush()
    assert store.version() == -1 and Store(spark, store.path).live().isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, 2 if i % 9 == 0 else 1, bytes([i % 13]), str(i).encode()) for i in range(200)], LOG)
    rows.repartitionByRange(4, "seq").write.parquet(f"{tmp_path}/log")
    for _ in range(2):  # a second start finds nothing new
        apply.write_runs(apply.log_stream(spark, f"{tmp_path}/log", rows.schema), f"{tmp_path}/runs", f"{tmp_path}/state").awaitTermination()
    assert found(log.live(spark.read.parquet(f"{tmp_path}/runs").drop("run_id")), "key", "value") == found(log.live(rows), "key", "value")
    seen: list[int] = []
    apply.apply_each(apply.log_stream(spark, f"{tmp_path}/log", rows.schema), lambda batch, n: seen.append(batch.count()), f"{tmp_path}/state2").awaitTermination()
    assert len(seen) == 4


def test_late_rows_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, f"2024-01-01 00:0{i}:00") for i in range(5)], "seq long, op int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionByName(rows).coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log")
    out = apply.once(stream, "ts", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    rates = apply.op_rates(stream, "ts", "1 minute", "10 seconds")
    assert json.loads(rates.schema.json())["fields"][0]["name"] == "window"


def test_crash_before_and_after_a_flush(spark, tmp_path):
    """What was put is there for whoever opens the folder next, flushed or not; a batch cut off while written is not."""
    store = Store(spark, str(tmp_path / "s"))
    store.put(puts(spark, 0, [(f"k{i}".encode(), b"v") for i in range(50)]))
    assert len(live(Store(spark, store.path))) == 50
    store.flush()
    store.put(puts(spark, 100, [(f"late{i}".encode(), b"v") for i in range(25)]))
    store.delete(spark.createDataFrame([(200, b"k0"), (201, b"late0")], "seq long, key binary"))
    (tmp_path / "s/log/000000099-000000000099").mkdir()  # without _SUCCESS
    again = Store(spark, store.path)
    assert len(live(again)) == 73 and again.open_count == 27
    again.put(puts(spark, 300, [(b"k0", b"new")]))
    assert len(live(Store(spark, store.path))) == 74
    again.close()
    assert len(live(Store(spark, store.path))) == 74 and Store(spark, store.path).batches == []


def test_sizes_close_segments_and_flush(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Settings(segment_bytes=100, memtable_bytes=400))
    for n in range(6):
        store.put(puts(spark, n, [(f"k{n}".encode(), b"x" * 50)]))
    assert store.totals["wal_rotate_total"] == 2 and store.totals["flush_total"] == 1
    assert (store.totals["put_total"], store.version(), len(store.batches)) == (6, 0, 1)
    assert len(live(store)) == 6


def test_a_batch_of_puts_and_deletes_is_one_run(spark, tmp_path):
    """However far it outgrows the memory."""
    store = Store(spark, str(tmp_path / "s"), Settings(memtable_bytes=100))
    store.put(puts(spark, 0, [(b"k0", b"old")]))
    store.apply(spark.createDataFrame([(1, 2, b"k0", b"ignored"), *((n, 1, f"k{n}".encode(), b"x" * 50) for n in range(2, 9))], LOG))
    assert (store.totals["flush_total"], store.totals["put_total"], store.totals["delete_total"], store.manifest().count(), store.batches) == (1, 8, 1, 1, [])
    assert [k for k, _ in live(store)] == [f"k{n}".encode() for n in range(2, 9)]
    assert store.manifest().first()["bytes"] == 8 * 10 + 7 * 50  # a tombstone has no value
    for op in (3, None):
        with pytest.raises(ValueError):
            store.apply(spark.createDataFrame([(20, op, b"k", b"v")], "seq long, op int, key binary, value binary"))
    assert store.batches == []


def test_backup_of_thirds_that_outgrow_the_memory(spark, tmp_path):
    n = 400_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 5000).alias("user_id"), F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("event_type"), (F.col("id") % 100).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    made = QUERIES["store_backup"](spark, str(tmp_path)).first()
    assert (made["total_files"], made["entries"], made["last_seq"]) == (3, 15_000, n - 1)


def test_asynchronous_puts_wait_for_the_next_sync(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Settings(durability="ASYNC"))
    store.put(puts(spark, 0, [(b"a", b"1")]))
    assert live(store) == [(b"a", b"1")] and live(Store(spark, store.path)) == []
    store.sync()
    assert live(Store(spark, store.path)) == [(b"a", b"1")]


def test_a_read_skips_runs_by_range_and_filter(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for n in range(3):
        store.put(puts(spark, 10 * n, [(f"{n}{c}".encode(), b"v") for c in "abc"]))
        store.flush()
    asked = spark.createDataFrame([(b"1a",), (b"1z",)], "key binary")
    found_ = store.multi_get(asked)
    assert len(found_.inputFiles()) == 1 and found(found_.where("value is not null"), "key") == [(b"1a",)]
    import pyarrow.parquet as pq

    files = [f.removeprefix("file:") for f in found_.inputFiles()]
    where = pq.ParquetFile(files[0].replace("//", "")).metadata.row_group(0).column(2)
    assert where.path_in_schema == "key" and where.statistics is not None
    plan = store.get(b"1a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key" in plan


def test_backups_are_stores(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Settings(level0_trigger=2))
    for n in range(2):
        store.put(puts(spark, 10 * n, [(f"{n}{c}".encode(), b"v") for c in "abc"]))
        store.flush()
    store.compact()
    for n in range(2, 4):
        store.put(puts(spark, 10 * n, [(f"{n}{c}".encode(), b"v") for c in "abc"]))
        if n == 2:
            store.flush()
    info = store.backup("full")
    assert (info["total_files"], info["entries"], info["last_seq"], info["total_bytes"]) == (3, 12, 32, 12 * 11)
    at = store.version()
    store.put(puts(spark, 100, [(b"new", b"v")]))
    assert store.backup("more", at)["total_files"] == 1 and store.backups() == ["full", "more"]
    assert len(live(Store(spark, f"{store.path}/snapshots/full"))) == 12
    assert live(Store(spark, f"{store.path}/snapshots/more")) == [(b"new", b"v")]
    before = live(store)
    store.vacuum()
    assert live(store) == before and store.check() == (4, [])
    broken = next((tmp_path / "s/runs").glob("*/*.parquet"))
    broken.write_bytes(b"PAR1" + b"x" * 40 + b"PAR1")
    n, bad = store.check()
    assert n == 4 and [b.rsplit("/", 1)[1] for b in bad] == [broken.parent.name]


def test_messages(spark):
    from stratalog.functions import messages as m

    raw = spark.createDataFrame([(5, 1, "键".encode(), b'{"a":1}'), (6, 2, b"", None), (7, 3, None, None), (8, 1, bytes(range(256)), None)], "seq long, op int, key binary, value binary")
    got = [tuple(None if x is None else x if isinstance(x, int) else bytes(x) for x in r["c"]) for r in raw.orderBy("seq").select(m.parse_command(m.command(F.col("op"), F.col("key"), F.col("value"))).alias("c")).collect()]
    assert got == [(1, "键".encode(), b'{"a":1}'), (2, b"", None), (3, None, None), (1, bytes(range(256)), b"null")]
    one = raw.where("seq = 5")
    assert bytes(one.select(m.command(F.col("op"), F.col("key"), F.col("value"))).first()[0]) == struct.pack(">bi", 1, 3) + "键".encode() + struct.pack(">i", 7) + b'{"a":1}'
    assert bytes(one.select(m.replication(F.col("seq"), F.col("op"), F.col("key"), F.col("value"))).first()[0]) == struct.pack(">qbi", 5, 1, 3) + "键".encode() + struct.pack(">i", 7) + b'{"a":1}'
    back = raw.where("op < 3").orderBy("seq").select(m.parse_replication(m.replication(F.col("seq"), F.col("op"), F.col("key"), F.col("value"))).alias("r")).select("r.*").collect()
    assert [(r["seq"], r["op"], bytes(r["key"]), r["value"] and bytes(r["value"])) for r in back] == [(5, 1, "键".encode(), b'{"a":1}'), (6, 2, b"", None), (8, 1, bytes(range(256)), None)]
    frame = bytes(one.select(m.request(F.lit(2), F.col("seq"), F.col("key"), F.col("value"))).first()[0])
    assert frame == struct.pack(">hbbqi", 0x4B56, 1, 2, 5, 3) + "键".encode() + struct.pack(">i", 7) + b'{"a":1}'
    cut = spark.createDataFrame([(frame[:-1],), (b"",)], "raw binary").select(m.parse_request(F.col("raw")).alias("q")).collect()
    assert [r["q"] for r in cut] == [None, None]
    for wrong in (b"\x00" + frame[1:], frame[:2] + b"\x02" + frame[3:]):
        with pytest.raises(Exception, match="frame"):
            spark.createDataFrame([(wrong,)], "raw binary").select(m.parse_request(F.col("raw"))).collect()
    answers = spark.createDataFrame([(b"1",), (None,)], "v binary").select(m.parse_get_response(m.get_response(F.col("v"))).alias("a")).collect()
    assert [(r["a"]["found"], r["a"]["value"] and bytes(r["a"]["value"])) for r in answers] == [(True, b"1"), (False, None)]
    assert bytes(one.select(m.parse_get_request(m.get_request(F.col("key")))).first()[0]) == "键".encode()


def test_line_client(spark, tmp_path):
    import io

    from stratalog import cli

    out = io.StringIO()
    cli.run(Store(spark, str(tmp_path / "s")), ["put a hello world", "get a", "get b", "del a", "get a", "put", "ping", "what", "put c 1", "exit", "put d 2"], out)
    assert out.getvalue().splitlines() == ["OK", "hello world", "(none)", "OK", "(none)", cli.HELP, "PONG", cli.HELP, "OK"]
    again = Store(spark, str(tmp_path / "s"))
    assert live(again) == [(b"c", b"1")] and cli.next_seq(again) == 4


def test_commands_of_a_stream(spark, tmp_path):
    rows = [(1, 1, b"a", b"1"), (2, 1, b"b", b"1"), (3, 3, None, None), (4, 2, b"a", None), (5, 1, b"c", b"1")]
    log_rows = spark.createDataFrame(rows, "seq long, op int, key binary, value binary")
    log_rows.where("seq <= 3").coalesce(1).write.parquet(f"{tmp_path}/log")
    store = Store(spark, str(tmp_path / "s"))
    go = lambda: apply.apply_commands(apply.log_stream(spark, f"{tmp_path}/log", log_rows.schema), store, f"{tmp_path}/state").awaitTermination()
    go()
    assert store.version() == 0 and store.batches == []
    log_rows.where("seq > 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    go()
    assert live(store) == [(b"b", b"1"), (b"c", b"1")] and store.version() == 0


def test_settings_are_read_anew(tmp_path):
    from stratalog.model import Watched

    heard = []
    watched = Watched(tmp_path / "s.json", lambda old, new: heard.append((old.level0_trigger, new.level0_trigger)))
    assert watched.current() == Settings()
    (tmp_path / "s.json").write_text('{"level0_trigger": 7}')
    assert watched.current().level0_trigger == 7 and heard == [(4, 7)]
    (tmp_path / "s.json").write_text('{"level0_trigger": ')
    assert watched.current().level0_trigger == 7
