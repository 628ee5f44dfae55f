"""Every named query with SQL gives what DuckDB gives for that SQL on the smallest tables."""

import math

import duckdb
import pytest

from plumbline.plans import catalog
from plumbline.plans.tables import NAMES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(cols).collect()), key=repr)
    if name in catalog.ORACLE_SQL:
        res = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in res.fetchall()), key=repr)
        assert got == want
    else:
        assert got
