"""Every query against its check SQL on the smallest tables."""

import pytest

from riskloom.plans.catalog import ALL
from tools.check import connect, table


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf, duck, name):
    run, sql = ALL[name]
    df = run(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, rows) == table(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["day", "id", "user", "is_malicious", "risk_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
