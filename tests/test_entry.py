import os

import duckdb
import pytest

import __spark_entry__ as entry
from assayframe.plans.oracle import ORACLE_SQL
from assayframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"nearest_neighbours_lsh"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def _plain(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY
    assert set(ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name in ROWS_ONLY:
        assert rows
        return
    expected = duck.sql(ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    want = [tuple(dict(zip(expected.columns, r))[c] for c in order) for r in expected.fetchall()]
    assert _plain([tuple(r[c] for c in order) for r in rows]) == _plain(want)
