"""Queries of the training-data operators that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from helixframe.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall()) != []
