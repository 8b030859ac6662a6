"""Every telemetry query against its oracle on the smallest tables, and the entry point."""

import duckdb
import pytest

from beaconry import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    result = oracle.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(tuple(map(norm, r)) for r in rows) == sorted(tuple(norm(r[i]) for i in order) for r in want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
