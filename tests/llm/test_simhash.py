import random

import numpy as np

from shorecover.llm import simhash


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"Word{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 6, 60, 200]))] for _ in range(30)]
    rows = []
    for k in range(160):
        w = list(base[k % 30])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (None, rows[3][1]), (None, "only this here"), (5, rows[5][1]), (903, "Ä ß " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as fp", "'x' as component_id", "3 as k")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in simhash.digest(simhash.near_duplicates(df)).collect()), key=key)
    assert got == sorted(simhash.brute_force(rows), key=key)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_of_dense_and_sparse_buckets(spark):
    rng = np.random.default_rng(2)
    center = int(rng.integers(2**62))
    near = {center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (400, 3))}
    fps = np.array(sorted(near | {int(x) for x in rng.integers(0, 2**63, 400)}), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = {}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4):
            parent[root(i)] = root(int(j))
    for i in range(len(fps)):
        want.setdefault(root(i), set()).add(int(fps[i].view(np.int64)))
    for n in (len(fps), 1 << 26):
        got = {}
        for r in simhash.components(simhash.links(df, n)).collect():
            got.setdefault(r.root, {r.root}).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_dense_buckets_are_cut(spark):
    """Buckets beyond DENSE are searched part by part and give the same components."""
    import random

    rng = random.Random(12)
    low = (1 << 30) - 1
    prints = {rng.getrandbits(14) << 45 | 0x155 for _ in range(3000)} | {rng.getrandbits(62) for _ in range(300)}
    prints = sorted(prints | {p ^ 1 << rng.randrange(30) for p in rng.sample(sorted(prints), 400)})
    df = spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "doc_id long, fp long")
    want = sorted(map(tuple, simhash.classes(df).collect()))
    was, simhash.DENSE = simhash.DENSE, 200
    try:
        assert sorted(map(tuple, simhash.classes(df).collect())) == want
    finally:
        simhash.DENSE = was
    group = list(range(len(prints)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert [c for _, _, c in want] == [find(i) for i in range(len(prints))] and low


def test_pieces_of_long_texts(monkeypatch):
    """Any cut into pieces gives the fingerprint by definition, at the edges of pieces and of the shingle size."""
    rng = random.Random(5)
    texts = ["", " ", "a", "\x0ba \t", "A b c", " a b c d ", "Ä b\r\nc d e", *[" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in range(1, 40)]]
    want = [int(x[1], 16) for x in simhash.brute_force([(k, t) for k, t in enumerate(texts)])]
    for piece in (1, 2, 3, 7, 16, 65536):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t, 4) for t in texts] == want
        assert all(len(h) <= piece for t in texts for h in simhash.shingle_hashes(t, 4))


def test_memory_of_a_long_text():
    import tracemalloc

    text = "some Words of a long text " * 400_000
    tracemalloc.start()
    simhash.fingerprint(text, 4)
    assert tracemalloc.get_traced_memory()[1] < 12 * len(text) + 100e6
