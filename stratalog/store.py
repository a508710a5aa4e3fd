"""A store on a shared folder: a facade over the log, runs and manifest.

A batch of puts or deletes is written to the log (`log/<segment>-<number>`) before the call
returns; with ASYNC durability it waits for the next sync, flush or close. A store that is
opened reads the batches that no run holds yet, so nothing written is lost by a crash. A
segment that outgrows `segment_bytes` is closed, and entries that outgrow `memtable_bytes`
are flushed. Runs are parquet folders with a Bloom filter on the key; `manifest/v=N` holds
all manifest rows of version N and is written after its runs, so a reader of the newest
version never sees half a change. Log batches go, oldest first, after the manifest that
holds them; replaying them twice changes nothing. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import DELETE, LEVELS, LOG, PUT, Settings
from .operators import compaction, log, runs

MANIFEST = "level int, run_id bigint, path string, min_key binary, max_key binary, entries bigint, bytes bigint, max_seq bigint, version bigint"
MANIFEST_COLUMNS = ("level", "run_id", "path", "min_key", "max_key", "entries", "bytes", "max_seq", "version")
REFUSED = "a row without a key or a seq"
UNKNOWN = "a row that is neither a put nor a delete"


class Store:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.totals = dict.fromkeys(("put_total", "get_total", "delete_total", "flush_total", "compaction_total", "wal_append_total", "wal_rotate_total"), 0)
        self.pending: DataFrame | None = None
        self._recover()

    # files

    def _fs(self):
        to = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return to.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _listed(self, folder: str) -> list[str]:
        """Names in a folder of the store; none if it isn't there."""
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _done(self, folder: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/{folder}/_SUCCESS"))

    def _remove(self, folder: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.path}/{folder}"), True)

    # log

    def _recover(self) -> None:
        """Finds the log batches that a former writer left; one cut off while it was written never was acknowledged and goes."""
        self.batches, self.segment, self.number, self.segment_bytes = [], 0, 0, 0
        for name in self._listed("log"):
            if self._done(f"log/{name}"):
                self.batches.append(name)
                self.segment, self.number = int(name.split("-")[0]), int(name.split("-")[1]) + 1
            else:
                self._remove(f"log/{name}")
        self.open_bytes, self.open_count = 0, 0
        if self.batches:
            self.segment += 1
            self.open_bytes, self.open_count = self._weighed(self.batches)[:2]

    def _logged(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/log/{n}" for n in names))

    def _weighed(self, names: list[str]) -> tuple[int, int, int]:
        """(memory, entries, puts) of log batches."""
        size = F.coalesce(F.sum(log.entry_bytes()), F.lit(0))
        return tuple(self._logged(names).agg(size, F.count("*"), F.count_if(F.col("op") == PUT)).first())

    def open_rows(self) -> DataFrame | None:
        """What no run holds yet: the log's batches, and with ASYNC durability what isn't in the log either."""
        rows = self._logged(self.batches) if self.batches else None
        if rows is None or self.pending is None:
            return self.pending if rows is None else rows
        return rows.unionByName(self.pending)

    def _append(self, rows: DataFrame) -> None:
        bad = F.col("key").isNull() | F.col("seq").isNull()
        key = F.when(bad, F.raise_error(F.lit(REFUSED)).cast("binary")).otherwise(F.col("key"))
        rows = rows.select(F.col("seq").cast("long").alias("seq"), F.col("op").cast("tinyint").alias("op"), key.alias("key"), F.col("value").cast("binary").alias("value"))
        self.pending = rows if self.pending is None else self.pending.unionByName(rows)
        if self.settings.durability != "ASYNC":
            self.sync()

    def sync(self) -> None:
        """Writes what is pending as one batch of the log; a batch is there once its _SUCCESS is."""
        if self.pending is None:
            return
        rows, self.pending = self.pending, None
        name = f"{self.segment:09d}-{self.number:012d}"
        try:
            rows.write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        except Exception as e:
            self._remove(f"log/{name}")
            for said in (REFUSED, UNKNOWN):
                if said in str(e):
                    raise ValueError(said) from e
            raise
        self.batches.append(name)
        self.number += 1
        size, entries, puts = self._weighed([name])
        self.open_bytes, self.open_count, self.segment_bytes = self.open_bytes + size, self.open_count + entries, self.segment_bytes + size
        for total, n in (("put_total", puts), ("delete_total", entries - puts), ("wal_append_total", entries)):
            self.totals[total] += n
        if self.segment_bytes > self.settings.segment_bytes:
            self.segment, self.segment_bytes = self.segment + 1, 0
            self.totals["wal_rotate_total"] += 1
        if self.open_bytes > self.settings.memtable_bytes:
            self.flush()

    def put(self, rows: DataFrame) -> None:
        """Adds puts of (seq, key, value); a null key or seq is refused when the batch is written."""
        self._append(rows.withColumn("op", F.lit(PUT)))

    def delete(self, keys: DataFrame) -> None:
        """Adds tombstones of (seq, key)."""
        self._append(keys.withColumn("op", F.lit(DELETE)).withColumn("value", F.lit(None).cast("binary")))

    def apply(self, rows: DataFrame) -> None:
        """Adds puts and tombstones of (seq, op, key, value) as one batch: all of it is in the log, and goes into a run, together."""
        op = F.when(F.col("op").isin(PUT, DELETE), F.col("op")).otherwise(F.raise_error(F.lit(UNKNOWN)).cast("int"))
        self._append(rows.select("seq", op.alias("op"), "key", F.when(F.col("op") == PUT, F.col("value")).alias("value")))

    # runs and manifest

    def version(self) -> int:
        """The newest manifest's number, -1 before the first."""
        return max((int(n.removeprefix("v=")) for n in self._listed("manifest") if self._done(f"manifest/{n}")), default=-1)

    def manifest(self) -> DataFrame:
        at = self.version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={at}") if at >= 0 else self.spark.createDataFrame([], MANIFEST)

    def _publish(self, rows: DataFrame, at: int) -> None:
        rows.select(*MANIFEST_COLUMNS).where("entries > 0").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={at}")

    def _write(self, rows: DataFrame, level: int, at: int, size: int, distinct: int, top: str | None = None) -> DataFrame:
        """Writes one run of about `size` bytes and `distinct` keys, and returns its manifest row, from the files as written."""
        to = f"{top or self.path}/runs/{at}-{level}"
        runs.write(rows.select("seq", "op", "key", "value"), to, files=max(1, -(-size // self.settings.file_bytes)), distinct=max(distinct, 1))
        zone = self.spark.read.schema(LOG).parquet(to).agg(
            F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.coalesce(F.sum(compaction.file_bytes(F.col("value"))), F.lit(0)).alias("bytes"), F.max("seq").alias("max_seq")
        )
        made = F.lit(at).cast("long")
        return zone.withColumns({"level": F.lit(level), "run_id": made, "path": F.lit(to), "version": made}).select(*MANIFEST_COLUMNS)

    def flush(self) -> None:
        """Writes what was added as one run of level 0; no-op if there is nothing. The log's batches go after it."""
        self.sync()
        if not self.batches:
            return
        at = self.version() + 1
        newest = log.latest(self._logged(self.batches))
        self._publish(self.manifest().unionByName(self._write(newest, 0, at, self.open_bytes, self.open_count)), at)
        for name in self.batches:  # the oldest first: what is left never shows an older state
            self._remove(f"log/{name}")
        self.batches, self.open_bytes, self.open_count, self.segment_bytes = [], 0, 0, 0
        self.segment += 1
        self.totals["flush_total"] += 1

    # reads

    def _read(self, manifest: DataFrame) -> DataFrame:
        paths = [r["path"] for r in manifest.select("path").collect()]  # one a run
        stored = self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)
        rows = self.open_rows()
        return stored if rows is None else stored.unionByName(rows)

    def rows(self, key: Column | None = None) -> DataFrame:
        """All entries of the runs that may hold the key, and those not flushed yet."""
        return self._read(self.manifest() if key is None else runs.candidates(self.manifest(), key))

    def live(self) -> DataFrame:
        return log.live(self.rows())

    def get(self, key: bytes) -> DataFrame:
        """The live row of a key. Runs go by their range, then their files by statistics and Bloom filter."""
        self.totals["get_total"] += 1
        return log.get(self.rows(F.lit(key)), key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Each asked key with its live row. Only runs whose range meets that of the asked keys are read."""
        span = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
        self.totals["get_total"] += span[2]
        low, high = (F.lit(bytes(x)) if x is not None else F.lit(None).cast("binary") for x in span[:2])
        return log.multi_get(self._read(compaction.overlapping(self.manifest(), low, high)), keys)

    # maintenance

    def compact(self) -> list[int]:
        """Merges each level that is due into the next, top down; the levels that were."""
        done = []
        for level in range(LEVELS - 1):
            manifest = self.manifest()
            sizes = compaction.due(runs.level_stats(manifest), self.settings).where(F.col("due") & (F.col("level") == level))
            if sizes.isEmpty():
                continue
            own = manifest.where(F.col("level") == level)
            span = own.agg(F.min("min_key"), F.max("max_key")).first()
            below = compaction.overlapping(manifest.where(F.col("level") == level + 1), F.lit(span[0]), F.lit(span[1]))
            chosen = own.unionByName(below).select("level", "run_id", "path", "entries", "bytes").collect()  # one row a run
            rest = manifest.join(self.spark.createDataFrame([r[:2] for r in chosen], "level int, run_id bigint"), ["run_id", "level"], "left_anti")
            bottom = rest.where(F.col("level") > level).isEmpty()
            source = self.spark.read.schema(LOG).parquet(*(r["path"] for r in chosen))
            at = self.version() + 1
            made = self._write(compaction.merge(source, bottom), level + 1, at, sum(r["bytes"] for r in chosen), sum(r["entries"] for r in chosen))
            self._publish(rest.select(*MANIFEST_COLUMNS).unionByName(made), at)
            self.totals["compaction_total"] += 1
            done.append(level)
        return done

    def vacuum(self) -> None:
        """Removes runs and manifests that only older versions need; nobody may be reading those."""
        at = self.version()
        held = {r["path"].rsplit("/", 1)[1] for r in self.manifest().select("path").collect()}
        for name in self._listed("runs"):
            if name not in held:
                self._remove(f"runs/{name}")
        for name in self._listed("manifest"):
            if name != f"v={at}":
                self._remove(f"manifest/{name}")

    def check(self) -> tuple[int, list[str]]:
        """(files, paths of damaged runs): a run is whole if all of it can be read and holds what the manifest says."""
        listed, bad = self.manifest().select("path", "entries").collect(), []  # one row a run
        for r in listed:
            try:
                whole = self.spark.read.schema(LOG).parquet(r["path"]).agg(F.count("*"), F.count("seq"), F.count("key"), F.sum(F.octet_length("value"))).first()
                bad += [r["path"]] * (tuple(whole[:3]) != (r["entries"],) * 3)
            except Exception:  # whatever a reader says of a damaged file
                bad.append(r["path"])
        return len(listed), bad

    # snapshots

    def snapshot(self, since: int = -1) -> DataFrame:
        """The manifest rows of runs made after a version: a full snapshot, or an increment."""
        return self.manifest().where(F.col("version") > since)

    def backup(self, name: str, since: int = -1) -> dict:
        """Copies the runs made after a version to `snapshots/<name>`, itself a store, and what it holds to `info` there.

        Open entries are flushed first. `last_seq` is the log offset that the copy stands for.
        """
        self.flush()
        top, at = f"{self.path}/snapshots/{name}", self.version()
        chosen = self.snapshot(since).collect()  # one row a run
        copies = [self._write(self.spark.read.schema(LOG).parquet(r["path"]), r["level"], r["run_id"], r["bytes"], r["entries"], top) for r in chosen]
        rows = self.spark.createDataFrame([], MANIFEST)
        for c in copies:
            rows = rows.unionByName(c)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{top}/manifest/v={max(at, 0)}")
        totals = self.spark.read.schema(MANIFEST).parquet(f"{top}/manifest/v={max(at, 0)}").agg(
            F.count("*").alias("total_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.max("max_seq").alias("last_seq")
        )
        totals.withColumns({"name": F.lit(name), "version": F.lit(at), "since": F.lit(since)}).coalesce(1).write.mode("overwrite").json(f"{top}/info")
        return self.backup_info(name)

    def backups(self) -> list[str]:
        """Names of the finished backups."""
        return [n for n in self._listed("snapshots") if self._done(f"snapshots/{n}/info")]

    def backup_info(self, name: str) -> dict:
        schema = "name string, version int, since int, total_files long, total_bytes long, entries long, last_seq long"
        return self.spark.read.schema(schema).json(f"{self.path}/snapshots/{name}/info").first().asDict()

    def stats(self) -> DataFrame:
        return runs.level_stats(self.manifest())

    def close(self) -> None:
        self.flush()
