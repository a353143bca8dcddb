"""Every registered query of the core with SQL, against DuckDB on the smallest tables."""

import glob
import importlib
import math
import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


from folioscope.plans.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if name not in ORACLES:
        return
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(canonical(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(canonical(r[c]) for c in sorted(columns)) for r in rows) == want


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert {"p1_found", "p2_found"} <= entry.queries().keys() or importlib.util.find_spec("folioscope.llm") is None
    assert not [n for n in QUERIES if re.match(r"(op|p)\d+_", n)]
    assert entry.entry(spark).columns
