"""Every registered query beside its DuckDB statement."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracles
from check_oracles import TABLES, compare

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
NAMES = list(oracles.QUERIES)


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for table in TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return made


def test_every_query_has_an_oracle():
    optional = set(entry.queries()) - set(NAMES)
    assert set(NAMES) <= set(entry.queries())
    assert all(name.startswith("op") or name == "pipeline" for name in optional)


@pytest.mark.parametrize("left_out", [("tokenmill/llm", "tests/llm"), ("tokenmill/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_the_optional_parts(tmp_path, left_out):
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    names = {str(root / n) for n in left_out}
    shutil.copytree(
        root, copy, ignore=lambda d, files: [f for f in files if f in (".git", "__pycache__") or f"{d}/{f}" in names]
    )
    code = "import __spark_entry__ as e; print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert set(done.stdout.split()) == set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    same, detail = compare(entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name]))
    assert same, detail
