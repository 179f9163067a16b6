"""Every query against its SQL, or at least its rows, on the smallest tables."""

import os

import duckdb
import pytest

from textfacts.queries import QUERIES, SQL

DIR = os.environ.get("TEXTFACTS_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str(tuple(r[k] for k in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())
    else:
        assert len(set(got.columns)) == len(got.columns)
