"""Every query with SQL against DuckDB, and what may import what."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillrun.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sql = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quillrun").rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "quillrun.llm" not in text and "from ..llm" not in text and "from .llm" not in text


def test_entry_without_the_subpackage(tmp_path):
    subprocess.run(["cp", "-r", f"{ROOT}/quillrun", f"{ROOT}/__spark_entry__.py", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/quillrun/llm"], check=True)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES), done.stderr
