"""Queries that stand beside one over an id range cover every id of their table."""

from __future__ import annotations

import os
import re

import pytest

from stratalog.catalog import QUERIES
import stratalog.plans  # noqa: F401  (registers the queries)

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def test_every_run_has_its_overlaps(spark):
    ranges: dict[int, tuple[int, int]] = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_orderkey").collect():
        low, high = ranges.get(r[0], (r[1], r[1]))
        ranges[r[0]] = min(low, r[1]), max(high, r[1])
    expected = {x: sum(x != y and b >= low and a <= high for y, (low, high) in ranges.items()) for x, (a, b) in ranges.items()}
    assert {r["run_id"]: r["overlaps"] for r in QUERIES["overlap_counts"](spark, DATA).collect()} == expected


def test_overlaps_are_counted_without_a_join_of_ranges(spark):
    """A row a pair would be as many as the square of the runs."""
    plan = QUERIES["overlap_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join .*(>=|<=)", plan)


def test_every_customer_is_looked_up(spark):
    asked = [str(r[0]) for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()]
    assert sorted(r["k"] for r in QUERIES["multi_get"](spark, DATA).collect()) == sorted(asked)
