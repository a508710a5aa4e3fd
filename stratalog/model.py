"""Schemas and codes of the data model."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE, FLUSH = 1, 2, 3
#: Bytes that an entry costs besides key and value, in memory and in a sorted file.
PUT_COST, DELETE_COST, FILE_COST = 32, 16, 8
LEVELS = 7

LOG = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType())])


@dataclass(frozen=True)
class Settings:
    """Sizes in bytes. `sync_every` is the trigger interval of streaming writers.

    durability: with SYNC and BATCH a put returns once its batch is in the log; with ASYNC it returns at once.
    """

    segment_bytes: int = 1 << 20
    memtable_bytes: int = 4 << 20
    file_bytes: int = 8 << 20
    level0_trigger: int = 4
    durability: str = "BATCH"
    sync_every: str = "1 second"

    def __post_init__(self) -> None:
        for name in ("segment_bytes", "memtable_bytes", "file_bytes", "level0_trigger"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.durability not in ("SYNC", "BATCH", "ASYNC"):
            raise ValueError(f"unknown durability {self.durability}")

    @staticmethod
    def load(path: str | Path) -> Settings:
        """From a JSON object; absent file or fields take the defaults, unknown fields are ignored."""
        path = Path(path)
        given = json.loads(path.read_text()) if path.exists() else {}
        return Settings(**{f.name: given[f.name] for f in fields(Settings) if given.get(f.name) is not None})


class Watched:
    """Settings of a file, read anew between batches when it changed; a listener hears of old and new ones."""

    def __init__(self, path: str | Path, listener: Callable[[Settings, Settings], None] | None = None):
        self.path, self.listener = Path(path), listener
        self.seen, self.settings = self._stamp(), Settings.load(path)

    def _stamp(self) -> tuple[int, int] | None:
        return (s.st_mtime_ns, s.st_size) if self.path.exists() and (s := self.path.stat()) else None

    def current(self) -> Settings:
        """The newest settings; a file that can't be read or is wrong leaves the old ones."""
        if (stamp := self._stamp()) != self.seen:
            self.seen = stamp
            try:
                new = Settings.load(self.path)
            except (ValueError, TypeError):
                return self.settings
            old, self.settings = self.settings, new
            if self.listener and new != old:
                self.listener(old, new)
        return self.settings


def thresholds(settings: Settings = Settings()) -> dict[int, int]:
    """Files at which each level is merged into the next."""
    return {0: settings.level0_trigger, **{n: 10**n for n in range(1, LEVELS)}}


def op_code(op: Column) -> Column:
    """op itself; an unknown code fails the query."""
    return F.when(op.isin(PUT, DELETE, FLUSH), op).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op.cast("string"), F.lit("null")))).cast("int"))


def checked(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a key and a known op, rejected rows)."""
    good = F.col("key").isNotNull() & F.col("seq").isNotNull() & F.coalesce(F.col("op").isin(PUT, DELETE), F.lit(False))
    return log.where(good), log.where(~good)


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which executors share; in local mode a temporary one where it is unset (tests)."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='stratalog-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{uuid.uuid4().hex}"
