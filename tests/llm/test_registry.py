"""The registered corpus queries against their oracles on the smallest tables."""

import duckdb
import pytest

from beaconry.llm import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(tuple(map(norm, r)) for r in rows) == sorted(tuple(norm(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_columns(spark, name):
    df = registry.queries()[name](spark, SF)
    assert "doc_id" in df.columns
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
