"""Every query with SQL gives DuckDB's rows; the others give rows of a stable schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from stratalog.catalog import ORACLES, QUERIES
import stratalog.plans  # noqa: F401  (registers the queries)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value: object) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    if name not in ORACLES:
        assert QUERIES[name](spark, DATA).schema == found.schema
        return
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(shown(dict(zip(names, r, strict=True))[c]) for c in columns) for r in got.fetchall())
