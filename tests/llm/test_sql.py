"""Queries with SQL give the same rows as DuckDB on the small tables."""

import duckdb
import pytest

from wordflow.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    rows = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want.fetchall(), key=key)
