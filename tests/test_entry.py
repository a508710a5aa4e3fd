"""The entry points, with and without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["k", "seq", "value"]
    assert rows.count() > 0


def test_imports_without_the_corpus_operators(tmp_path):
    """As after their folders and the pipeline are deleted."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("stratalog.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
names = set(e.queries())
assert "latest_by_key" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)
