"""Every registered query against its check SQL on the smallest data set."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of
from tests.conftest import SMALL
from opsloom.sources.tables import BASE_TABLES

QUERIES = entry.queries()
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if name not in CHECKS:
        assert got and len(set(df.columns)) == len(df.columns) == len(got[0])
        if re.match("op([1-9]|1[0-3])_", name) and "doc_id" in df.columns:
            # One row per document, whatever else the operator says of it.
            assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(
                r[0] for r in duck.execute("select doc_id from documents").fetchall()
            )
        return
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert rows_of(df.columns, got) == rows_of(names, result.fetchall())


def test_entry_is_lazy_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "service_name" and len(df.columns) == 9


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
