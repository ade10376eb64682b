"""Every named query that has a SQL twin gives its rows."""

import math

import pytest

from stemma.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations")


def tidy(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    import duckdb

    found = catalog.queries()[name](spark, data)
    columns = sorted(found.columns)
    got = [tuple(tidy(r[c]) for c in columns) for r in found.collect()]
    if name not in catalog.oracle_sql():
        assert found.columns
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    twin = c.sql(catalog.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    order = [twin.columns.index(x) for x in columns]
    want = [tuple(tidy(row[i]) for i in order) for row in twin.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
