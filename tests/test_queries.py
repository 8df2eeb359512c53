"""Every query that has SQL, on the smallest tables, against DuckDB."""

import glob
import os

import duckdb
import pytest

from meshquery import catalog_queries, map_queries, operator_queries, page_queries, scale_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    held.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        held.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return held


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, con, name):
    got, want = catalog_queries.queries()[name](spark, SF).toArrow(), con.sql(catalog_queries.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted(str([r[c] for c in sorted(t.column_names)]) for r in t.to_pylist())
    assert rows(got) == rows(want)
