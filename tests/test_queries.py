"""Every registered query of the reading-corpus operators against its SQL in DuckDB, on the given tables."""

import glob
import os

import duckdb
import pytest

from lectern.plans import registry

SFS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.fixture(scope="module", params=SFS)
def duck(request):
    """The folder of the given tables, and a connection with a view of each."""
    if not os.path.isdir(request.param):
        pytest.skip("needs the given tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{request.param}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return request.param, con


def cells(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    folder, con = duck
    sql = registry.oracle_sql().get(name)
    if sql is None and folder != SFS[0]:
        pytest.skip("runs on one folder, without SQL")
    got = registry.queries()[name](spark, folder)
    rows = got.collect()
    if sql is None:
        assert got.columns
        return
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert cells(got.columns, rows) == cells(columns, want.fetchall())
