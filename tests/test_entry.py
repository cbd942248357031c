from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest


def load():
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_under_test", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_names():
    entry = load()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 60


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no driver tables")
def test_flagship(spark):
    rows = load().entry(spark).collect()
    assert rows and sum(r.pages for r in rows) == 50
