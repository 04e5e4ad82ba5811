"""Every query of the analytics engine with SQL, against DuckDB on the same files."""

from __future__ import annotations

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, v if v is not None else 0) for v in row))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    expected = [tuple(row[theirs.index(c)] for c in columns) for row in cursor.fetchall()]
    assert _sorted(tuple(row[c] for c in columns) for row in df.collect()) == _sorted(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0
