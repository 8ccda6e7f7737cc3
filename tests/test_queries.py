"""All registered queries against their SQL twins on the smallest tables.

``python -m checks.compare`` does so at any scale.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

# The text operators have their own tests.
NAMES = [name for name in entry.oracle_sql() if name not in entry.TEXT_QUERIES]


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, db, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(rows_of(got)) == sorted(rows_of(want))
