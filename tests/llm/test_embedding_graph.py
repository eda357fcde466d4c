"""Near duplicates of embeddings against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorecover.llm import catalog, embedding_graph
from shorecover.llm.embedding_graph import Settings


def brute(rows, similarity=0.95):
    """[(id, n_links, component)] of (id, vector) rows; vectors that can't link are None."""
    width = max((len(v) for _, v in rows if v is not None), default=1)
    at = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None]
    units = np.array([list(rows[k][1]) + [0.0] * (width - len(rows[k][1])) for k in at]).reshape(len(at), width)
    units = units / np.abs(units).max(1, keepdims=True, initial=1e-300)
    units = units / np.sqrt((units**2).sum(1, keepdims=True))
    near = units @ units.T >= similarity
    near |= (units[:, None] == units[None]).all(2) if len(units) < 1500 else False
    np.fill_diagonal(near, False)
    root = np.array([rows[k][0] for k in at])
    while True:
        low = np.minimum(root, np.where(near, root, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (low == root).all():
            break
        root = low
    out = [(i, 0, i) for i, _ in rows]
    for k, n, r in zip(at, near.sum(1), root, strict=True):
        out[k] = (rows[k][0], int(n), int(r))
    return out


def groups(rng, n, spread, dims=16):
    """n vectors around one, at cosines of some 1 - spread."""
    centre = rng.normal(size=dims)
    return centre + rng.normal(size=(n, dims)) * np.linalg.norm(centre) / np.sqrt(dims) * spread


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    parts = [rng.normal(size=(600, 16)), groups(rng, 300, 0.05), groups(rng, 40, 0.1), *[groups(rng, 2, 0.15) for _ in range(120)], *[groups(rng, 9, 0.02) for _ in range(20)]]
    vectors = np.concatenate(parts)
    vectors = np.concatenate((vectors, vectors[600:640], 3 * vectors[700:710]))
    order = rng.permutation(len(vectors))
    return [(int(k), vectors[at].tolist()) for k, at in enumerate(order)]


@pytest.mark.parametrize("how", [Settings(), Settings(shard=64, region=256), Settings(shard=40, region=100, overlap=2)])
def test_against_all_pairs(spark, table, how):
    """Dense groups, pairs near the limit, equal and scaled vectors; regions of one block and of several."""
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(6)
    found = embedding_graph.near_duplicates(df, how)
    got, want = {r.vec_id: r for r in found.rows.collect()}, {i: (n, c) for i, n, c in brute(table)}
    assert set(got) == set(want) and found.recall >= 0.98
    n = sum(r.n_links for r in got.values())
    assert 0.98 * sum(v[0] for v in want.values()) <= n <= sum(v[0] for v in want.values())
    assert all(r.n_links <= want[i][0] and r.component_id >= want[i][1] and r.kept == (i == r.component_id) for i, r in got.items())
    assert sum(r.component_id == want[i][1] for i, r in got.items()) >= 0.99 * len(got)


def test_real_table(spark):
    """The whole table as it is, and each twelfth vector four times more, moved a little."""
    at = "/root/testdata/sf0.1"
    whole = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in catalog.op12_embedding_dedup(spark, at).collect()) == sorted(brute(whole))
    rng = np.random.default_rng(1)
    copies = [(10_000 * k + i, (np.array(v) + rng.normal(size=len(v)) * 0.01).tolist()) for i, v in whole if i % 12 == 0 for k in range(1, 5)]
    found = embedding_graph.near_duplicates(spark.createDataFrame(whole + copies, "vec_id long, embedding array<double>"))
    got, want = {(r.vec_id, r.n_links, r.component_id) for r in found.rows.collect()}, set(brute(whole + copies))
    assert len(got & want) >= 0.98 * len(want) and sum(n for _, n, _ in got) >= 0.98 * sum(n for _, n, _ in want) > 0


def test_odd_rows(spark):
    """Nulls, zeros, non-finite, short, huge and tiny vectors, repeated rows, a null id, clashing names; an empty table."""
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, v), (3, [1e200, 2e200, 3e200]), (4, [1e-200, 2e-200, 3e-200]), (5, None), (6, [0.0, -0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [float("nan")] * 3), (9, [float("inf"), 1.0, 1.0]), (None, v), (10, [5.0]), (11, [5.0, 0.0, -0.0]), (12, []), (13, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in rows], "vec_id long, embedding array<double>, n_links int, id int").repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_graph.near_duplicates(df).rows.collect()), key=str)
    # the repeated row is a vector of its own
    want = [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False), *[(k, 0, k, True) for k in (5, 6, 7, 8, 9, 12, 13)], (10, 1, 10, True), (11, 1, 10, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert embedding_graph.near_duplicates(df.limit(0)).rows.count() == 0
    assert embedding_graph.near_duplicates(df.where(F.col("vec_id").isin(5, 6))).rows.count() == 2


def test_audit_widens(spark, table, monkeypatch):
    """A build that finds little is measured as such, and run again with more overlap."""
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    tried = []
    real = embedding_graph.search

    def poor(found, lists, how, k):
        tried.append(how.overlap)
        out = real(found, lists, how, k)
        return out.where("id % 3 = 0") if len(tried) == 1 else out

    monkeypatch.setattr(embedding_graph, "search", poor)
    assert embedding_graph.near_duplicates(df).recall >= 0.98 and tried == [3, 6]


def test_pruning():
    """What lies nearer to a kept neighbour than to the node goes; a far direction stays."""
    at = np.radians([0, 1, 2, 3, -1.5, 40])
    units = np.stack((np.cos(at), np.sin(at)), 1).astype(np.float32)
    near = embedding_graph.pruned(units, Settings(degree=3, pool=5), 0)[0, :3]
    assert near.tolist() == [1, 4, 5]
