import duckdb
import pytest

import __spark_entry__ as e
from tallyframe import queries as own

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = own.QUERIES[name](spark, SF)
    want = con.execute(own.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(*columns).toPandas().values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_entry(spark):
    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
