"""Every query with checking SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyloom import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return db


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name in queries.ORACLES:
        result = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr([plain(row[i]) for i in at]) for row in result.fetchall())
