"""Every catalogue query against its SQL on the smallest tables."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from postledger.plans.catalogue import QUERIES
from postledger.plans.oracles import ORACLES as SQL
from tests_support import TABLES


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return int(value)
    if isinstance(value, datetime.date):
        return str(value)
    return value


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def test_every_query_has_a_check():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, sql, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    result = sql.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
