"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


def names():
    from catchment.plans import registry

    return sorted(registry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_equals_duckdb(spark, name):
    from catchment.plans import registry

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda df: sorted(tuple(str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))
    a, b = key(got), key(want)
    assert len(a) == len(b) and a == b
