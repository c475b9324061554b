"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from webloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    got = rows_of(registry.queries()[name](spark, SF).toPandas())
    assert got == rows_of(con.sql(registry.oracle_sql()[name]).df())
