"""Every query against its SQL, at the smallest scale."""

import importlib.util
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

from lontar.plans import event_queries, file_queries, table_queries  # noqa: E402, F401
from lontar.plans.queries import ORACLES, QUERIES  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted(str(tuple(plain(r[columns.index(c)]) for c in order)) for r in rows)


@pytest.fixture(scope="module")
def db(sf):
    out = duckdb.connect()
    for t in TABLES.split():
        out.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    assert rows or name in ("lint_documents", "search_key_collisions")
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("missing", ["the subpackage", "a library"])
def test_entry_without_the_subpackage(tmp_path, missing):
    for name in ("__spark_entry__.py", "lontar"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    if missing == "the subpackage":
        shutil.rmtree(tmp_path / "lontar/llm", ignore_errors=True)
    elif (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
