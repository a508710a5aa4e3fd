"""The package's source for Python workers, which on a cluster don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once a session."""
    context = spark.sparkContext
    if getattr(context, "_stratalog_shipped", False):
        return
    package = Path(__file__).resolve().parent
    to = f"{tempfile.mkdtemp(prefix='stratalog-')}/stratalog_source.zip"
    with zipfile.ZipFile(to, "w") as out:
        for f in package.rglob("*.py"):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(to)
    context._stratalog_shipped = True
