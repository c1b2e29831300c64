"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from quarkflow.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries()[name](spark, data)
    want = con.execute(oracle_sql()[name])
    at = [[c[0] for c in want.description].index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_all_queries_are_there():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
