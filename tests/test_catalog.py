"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from founderflow.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(table):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    names = sorted(table.column_names)
    return sorted(repr(tuple(plain(r[n]) for n in names)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("set threads = 4")
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = con.execute(catalog.ORACLES[name]).to_arrow_table()
    got = catalog.QUERIES[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_without_sql(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(catalog.QUERIES) <= len(e.queries())
