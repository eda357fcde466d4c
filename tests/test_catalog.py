"""Every registered query of the coverage library against its SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from shorecover import catalog

DIR = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "embeddings", "supplier"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(row):
    return tuple(f"{x + 0.0:.6f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got or name in ROWS_ONLY
    if name in ROWS_ONLY:
        return
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == columns
    assert got == sorted(plain(r) for r in found.select(", ".join(f'"{c}"' for c in columns)).fetchall())
