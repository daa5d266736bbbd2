"""Queries with SQL give what DuckDB gives."""

import duckdb
import pytest

from tessera.llm import registry

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, DATA)
    result = db.execute(registry.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(frame.columns)
    own = sorted(tuple(str(r[c]) for c in names) for r in frame.collect())
    assert own == sorted(tuple(str(x) for x in r) for r in result.fetchall())
