"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    spark.catalog.clearCache()
    if name not in catalog.oracle_sql():
        assert rows
        return
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in got.fetchall())


def test_entry(spark):
    assert catalog.entry(spark, SF).count() > 0
