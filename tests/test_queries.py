"""Control queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.plans import control_queries, queries

NAMES = sorted(n for n, f in queries.queries().items() if f.__module__ == control_queries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_the_sql(spark, data, name):
    made = queries.queries()[name](spark, data)
    columns = sorted(made.columns)
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in made.select(*columns).collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))
