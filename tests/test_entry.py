"""The driver's contract: a query for each operator, run on the smallest tables against its SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from geoledger.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None or isinstance(v, (bool, str)):
            return v
        return None if math.isnan(v) else round(float(v), 6) + 0.0

    return sorted(([plain(r[i]) for i in order] for r in values), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    sql = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in sql.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, sql.fetchall())
