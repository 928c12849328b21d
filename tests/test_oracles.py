"""Every query with SQL gives DuckDB's rows, and the registry is whole."""

import math

import pytest

import __spark_entry__ as entry
import helixframe.plans.format_queries  # noqa: F401  (registers its queries)
from helixframe.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    con = duck.execute(ORACLE[name])
    columns = [d[0] for d in con.description]
    assert sorted(got.columns) == sorted(columns)
    ours, theirs = rows_of(got.columns, got.collect()), rows_of(columns, con.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_registry():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark, sf):
    got = entry.entry(spark)
    assert got.columns == ["motif_idx", "region_id", "n_sites"] and got.count() > 0
