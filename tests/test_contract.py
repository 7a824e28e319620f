"""Names and SQL of all queries; a sample of them against DuckDB over the smallest tables."""

import math
import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TIDELINE_TESTDATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200
    assert {f"p{n}_found" for n in range(1, 6)} <= set(queries)


def test_nothing_outside_imports_llm():
    root = Path(entry.__file__).parent / "tideline"
    modules = [p for p in root.rglob("*.py") if p.parent.name != "llm"]
    assert len(modules) > 25
    for p in modules:
        assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


SAMPLE = sorted(n for n in entry.oracle_sql() if n[:2] not in ("p6", "p7", "p8"))[::6] + ["p2_found", "p3_found", "p4_found", "flagship_cross_pnl"]


@pytest.mark.parametrize("name", sorted(set(SAMPLE)))
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    res = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in res.fetchall()), key=str)


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert entry.entry(spark).columns
