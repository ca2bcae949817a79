import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakeseek import catalog

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def key(rows, cols):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), list(want.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
