"""Every registered reference query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from harrow.plans import further, live, registry  # noqa: F401  the first two register their queries with registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    keys = sorted(columns)
    got = sorted((tuple(plain(r[k]) for k in keys) for r in rows), key=repr)
    want = sorted((tuple(plain(r[columns.index(k)]) for k in keys) for r in cursor.fetchall()), key=repr)
    assert got == want
