"""Every named query with check SQL against DuckDB on the smallest tables; the others must return rows."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
# A size range over a handful of recursion steps; one row per model version, whose name is a constant.
NESTED_LOOPS = {"sql_recursive", "forest_train_score"}
QUERIES, CHECK = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    shape = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in shape
    if name not in NESTED_LOOPS:
        assert "BroadcastNestedLoopJoin" not in shape
    got = df.collect()
    if name not in CHECK:
        assert got
        return
    cur = duck.execute(CHECK[name])
    names = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == names
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in got) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


def test_check_sql_belongs_to_queries():
    assert set(CHECK) <= set(QUERIES)


def test_stored_edges_are_sketched_too(spark):
    """The index from sketched edges is computed and held against the exact profile."""
    out = QUERIES["psi_stored_edges"](spark, SF)
    assert out.columns == ["feature", "psi", "sketch_close"]
    assert all(r.sketch_close for r in out.collect())
