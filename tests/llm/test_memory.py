"""What the pipeline's stages send to Python workers at once, and what these keep of it."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import pytest
from cases import DOCS
from test_pipeline import rows

from stratalog.llm.common import BATCH, BATCH_KEY, bounded, released


@pytest.fixture
def unset(spark):
    """The session without a limit of its own; whatever a test sets goes."""
    spark.conf.unset(BATCH_KEY)
    yield
    spark.conf.unset(BATCH_KEY)


@pytest.mark.parametrize("stage", [corpus_pipeline.identified, corpus_pipeline.deduplicated, corpus_pipeline.packed])
def test_batches_are_bounded(spark, folder, unset, stage):
    """12 MB of long texts in one partition don't go to a worker at once."""
    docs = spark.read.parquet(folder(documents=(rows(), DOCS)) + "/documents.parquet")
    stage(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    long = spark.range(120, numPartitions=1).selectExpr("id", "repeat('word ', 20000) AS text")
    seen = long.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in seen) == 120
    assert len(seen) > 1 and max(r["bytes"] for r in seen) <= BATCH + 110_000


def test_own_limit_stays(spark, unset):
    spark.conf.set(BATCH_KEY, "7m")
    bounded(spark)
    assert spark.conf.get(BATCH_KEY) == "7m"


def test_results_do_not_depend_on_batches(spark, folder, unset):
    """Stages keep and make the same rows by batches of a few texts as by Spark's own of 64 MB."""
    sf_dir, seen = folder(documents=(rows(), DOCS)), []
    for limit in ("64m", "2k"):
        spark.conf.set(BATCH_KEY, limit)
        docs, outs = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{limit}{k}")
            docs = spark.read.parquet(f"{sf_dir}/{limit}{k}")
            outs.append(docs)
        tokens: Counter = Counter()
        for p in outs.pop().collect():
            tokens[p["doc_id"]] += p["length"]
        seen.append([*(Counter(map(tuple, out.collect())) for out in outs), tokens])
    assert seen[0] == seen[1]


def test_freed_memory_goes_back():
    """What a task has freed is not kept by the worker, though something above it on the heap still lives."""
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    above = []

    def run(batches):
        freed = []
        for _ in range(3000):
            freed.append(bytearray(b"x" * 60_000))
            above.append(bytearray(1000))
        assert held() > before + 150
        freed.clear()
        yield from batches

    before = held()
    assert list(released(run)(iter([1, 2]))) == [1, 2]
    assert held() < before + 50
