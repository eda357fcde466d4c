"""Queries that go by names, on images that share them, as those of order keys of seven digits do, against their SQL."""

import duckdb
import pytest

from shorecover import catalog

QUERIES = ["inc_1_errors", "inc_1_watch", "join_1_metadata", "join_2_pending_images", "join_3_pending_results", "join_4_upsert", "prj_8_pick_images"]


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("same_names"))
    rows = "select 100000 + i as six, i, unnest(range(-1, i % 5)) as j from range(400) r(i)"
    keys = f"select case when j < 0 then six else 10 * six + j end as o_orderkey, i % 16 as o_custkey, 1e3 * i + j as o_totalprice, timestamp '1995-03-01' as o_orderdate from ({rows})"
    duckdb.sql(f"copy ({keys}) to '{path}/orders.parquet'")
    return path


def plain(row):
    return tuple(f"{x + 0.0:.6f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, orders, name):
    df = catalog.queries()[name](spark, orders)
    columns = ", ".join(sorted(df.columns))
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{orders}/orders.parquet'")
    want = sorted(plain(r) for r in con.sql(f"select {columns} from ({catalog.oracle_sql()[name]})").fetchall())
    assert want and sorted(plain(r) for r in df.select(*sorted(df.columns)).collect()) == want
