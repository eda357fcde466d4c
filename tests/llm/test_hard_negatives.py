"""Hard negatives against a full scan, and the threshold algorithm by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorecover.llm import catalog, hard_negatives
from shorecover.llm.hard_negatives import Lists, Want

SMALL, DIR = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def brute(rows):
    """rows: {id: (label, vector)}; the contract read row by row."""
    ids = sorted(rows)
    vectors = np.array([rows[i][1] for i in ids], object)
    out = set()
    for a in (i for i in ids if i % 100 == 0):
        scores = dict(zip(ids, vectors @ np.array(rows[a][1], object), strict=True))
        order = sorted(ids, key=lambda i: (-scores[i], i))
        for p in [i for i in order if i != a and rows[i][0] == rows[a][0]][:5]:
            near = [i for i in order if rows[i][0] != rows[a][0] and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]][:10]
            out |= {(a, p, rank, i, scores[p], scores[i]) for rank, i in enumerate(near, 1)}
    return out


def plain(table):
    rows = {}
    for i, v, label in table:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        rows[i] = min([(label, tuple(int(np.floor(256 * float(x))) for x in v)), *([rows[i]] if i in rows else [])])
    width = max((len(v) for _, v in rows.values()), default=0)
    return {i: (label, v + (0,) * (width - len(v))) for i, (label, v) in rows.items()}


@pytest.mark.parametrize("sizes", [(8192, 1024), (300, 7)])
def test_whole_table(spark, monkeypatch, sizes):
    """All rows, whatever the blocks."""
    monkeypatch.setattr(hard_negatives, "CANDIDATES", sizes[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    at = DIR if sizes[0] > 1000 else SMALL
    table = [tuple(r) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in catalog.op11_hard_negatives(spark, at).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(plain(table)) and got


def test_odd_rows(spark):
    """Nulls, non-finite and missing components, short vectors, zeros, ties, repeated ids, clashing names; an empty table."""
    rng = np.random.default_rng(5)
    table = [(k, rng.integers(-2, 3, 4).tolist(), int(rng.integers(0, 3))) for k in range(400)]
    table = [(k, [x / 4 for x in v], label) for k, v, label in table]
    table += [(None, [1.0] * 4, 1), (1000, None, 1), (1100, [1.0, None, 1.0, 0.0], 1), (1200, [float("nan")] * 4, 1), (1300, [float("inf"), 0.0, 0.0, 0.0], 1), (1400, [1.0] * 4, None), (1500, [0.0] * 4, 2), (1600, [0.5, 0.5], 2), (1700, [], 0), (200, [0.5] * 4, 2), (200, [0.5] * 4, 2)]
    df = spark.createDataFrame([(*t, 0, 0) for t in table], "vec_id long, embedding array<double>, label int, a int, id int").repartition(6)
    got = {tuple(r) for r in hard_negatives.mine_embeddings(df).collect()}
    assert got == brute(plain(table)) and got
    assert hard_negatives.mine_embeddings(df.limit(0)).count() == 0
    assert hard_negatives.mine_embeddings(df.where(F.col("vec_id") % 100 != 0)).count() == 0


def test_large_components(spark):
    """Scores beyond 2^53 stay exact."""
    table = [(k, [float(1000 + k) * 300, -7.0 * k, 123456.5], k % 2) for k in range(0, 205)]
    got = {tuple(r) for r in hard_negatives.mine_embeddings(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute(plain(table)) and got and max(r[4] for r in got) > 2**53


def test_search_stops_early():
    """Where one dimension decides, a few places of the lists are enough, and rows past the end are not scored."""
    n = 4000
    vectors = np.zeros((n, 3), np.int64)
    vectors[:, 0] = np.arange(n)
    lists = Lists.of(np.arange(n), np.zeros(n, int), vectors)
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    lists.vectors = lists.vectors.view(Counted)
    for anchor, best in ((np.array([5, 0, 0]), [n - 1, n - 2, n - 3]), (np.array([-5, 0, 0]), [0, 1, 2])):
        scored.clear()
        rows, scores = hard_negatives.search(lists, anchor, np.ones(n, bool), [Want(None, None, 3)])[0]
        assert rows.tolist() == best and scores.tolist() == [5 * int(anchor[0] / 5) * r for r in best] and sum(scored) <= 64


def test_ties_at_the_threshold():
    """The search goes on while unmet rows may equal the kth score, as the smaller id comes first."""
    vectors = np.tile(np.array([[3, 3]]), (500, 1))
    lists = Lists.of(np.arange(500)[::-1].copy(), np.zeros(500, int), vectors)
    rows, _ = hard_negatives.search(lists, np.array([1, 1]), np.ones(500, bool), [Want(None, None, 4)], depth=2)[0]
    assert lists.ids[rows].tolist() == [0, 1, 2, 3]
