"""Folders of small tables, as the driver's are, and DuckDB over them."""

from __future__ import annotations

import duckdb
import pytest
from cases import DOCS, ROWS, ordered


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables (rows, schema) into a folder; gives its path."""

    def write(**tables) -> str:
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def edges(folder):
    return folder(documents=(ROWS, DOCS), labels=([(4, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int"))


@pytest.fixture
def empty(folder):
    return folder(documents=([], DOCS), labels=([], "doc_id long, quality int, toxic int"), pages=([], "page_id long, url string, html string"), embeddings=([], "vec_id long, embedding array<float>, label int"))


@pytest.fixture
def oracle():
    """Rows of an SQL over a folder's tables, as sorted tuples of the columns asked for."""

    def run(sql: str, sf_dir: str, columns: tuple[str, ...], *names: str) -> list[tuple]:
        con = duckdb.connect()
        for n in names:
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet/*.parquet'")
        return ordered(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())

    return run
