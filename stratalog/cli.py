"""A line client over a store: python -m stratalog.cli FOLDER [SETTINGS.json]."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import Settings
from .store import Store

HELP = "get KEY | put KEY VALUE | delete KEY | flush | compact | stats | ping | help | exit"


def next_seq(store: Store) -> int:
    """One more than the largest seq of runs and log."""
    rows = store.open_rows()
    found = [store.manifest().agg(F.max("max_seq")).first()[0], rows.agg(F.max("seq")).first()[0] if rows is not None else None]
    return 1 + max((x for x in found if x is not None), default=0)


def run(store: Store, lines: Iterable[str], out: TextIO) -> None:
    """Answers each line; `exit`, `quit` or the end closes the store."""
    spark, seq = store.spark, next_seq(store)
    for line in lines:
        name, *rest = line.strip().split(None, 2)[:3] or [""]
        name = {"del": "delete", "quit": "exit"}.get(name.lower(), name.lower())
        wanted = {"get": 1, "put": 2, "delete": 1}.get(name, 0)
        if name == "exit":
            break
        if wanted > len(rest):
            print(HELP, file=out)
        elif name == "get":
            row = store.get(rest[0].encode()).first()
            print("(none)" if row is None else bytes(row["value"] or b"").decode("utf-8", "replace"), file=out)
        elif name == "put":
            store.put(spark.createDataFrame([(seq, rest[0].encode(), rest[1].encode())], "seq long, key binary, value binary"))
            seq += 1
            print("OK", file=out)
        elif name == "delete":
            store.delete(spark.createDataFrame([(seq, rest[0].encode())], "seq long, key binary"))
            seq += 1
            print("OK", file=out)
        elif name in ("flush", "compact"):
            getattr(store, name)()
            print("OK", file=out)
        elif name == "stats":
            print(" ".join(f"{k}={v}" for k, v in store.totals.items()), file=out)
        elif name == "ping":
            print("PONG", file=out)
        elif name:
            print(HELP, file=out)
    store.close()


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    run(Store(session, sys.argv[1], Settings.load(sys.argv[2]) if len(sys.argv) > 2 else Settings()), sys.stdin, sys.stdout)
    session.stop()
