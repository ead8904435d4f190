"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from tremor.plans import oracles, queries


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    want = con.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_every_query_has_sql_or_is_known_not_to():
    assert set(queries.QUERIES) - set(oracles.ORACLES) == {"detection_report", "detection_results_json"}
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
