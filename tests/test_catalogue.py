"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quern import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _normal(columns, rows):
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([str(r[k]) for k in by]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    found = duck.execute(catalogue.ORACLES[name])
    got, want = _normal(df.columns, df.collect()), _normal([c[0] for c in found.description], found.fetchall())
    assert got == want and got[1]


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())
