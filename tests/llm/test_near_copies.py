import random

import numpy as np

from shorecover.llm import near_copies

WORDS = [f"Word{k}" for k in range(4000)]


def _edited(words, share, rng):
    """A copy in which so large a share of the words is replaced, in runs, that about 1 - share of the shingles are kept."""
    out = list(words)
    n = round(share * len(words))
    at = rng.randrange(len(words) - n + 1)
    out[at : at + n] = [rng.choice(WORDS) for _ in range(n)]
    return out


def _likeness(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_copies_and_strangers(spark):
    """Pairs beyond the limit link, pairs well below don't; the same as comparing all fingerprints."""
    rng = random.Random(5)
    rows, far = [], []
    for k in range(120):
        base = [rng.choice(WORDS) for _ in range(rng.choice([100, 200, 900]))]
        near = _edited(base, rng.choice([0.0, 0.01, 0.03]), rng)
        other = _edited(base, 0.4, rng)
        assert _likeness(base, near) > 0.84 and _likeness(base, other) < 0.6
        rows += [(3 * k, " ".join(base)), (3 * k + 1, "\n".join(near).upper()), (3 * k + 2, " ".join(other))]
        far.append(3 * k + 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as fp", "'x' as wide", "2 as k", "3L as component_id")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert all(got[3 * k] == got[3 * k + 1] == 3 * k for k in range(120))
    assert all(got[i] == i for i in far)
    assert got == dict(near_copies.brute_force(rows))


def test_recall_by_likeness(spark):
    """Pairs at a Jaccard likeness of 2/3 (a cosine of 0.8) and more are linked, but for a few at the limit."""
    rng = random.Random(15)
    rows, at = [], {}
    for k in range(300):
        base = [rng.choice(WORDS) for _ in range(300)]
        near = _edited(base, rng.choice([0.05, 0.1, 0.17]), rng)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        at[k] = _likeness(base, near)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {k: got[2 * k] == got[2 * k + 1] for k in at}
    share = lambda lo, hi: np.mean([linked[k] for k in at if lo <= at[k] < hi])
    assert share(0.66, 0.72) >= 0.95 and share(0.76, 1.1) == 1.0


def test_one_group_of_many_copies(spark):
    rng = random.Random(6)
    base = [rng.choice(WORDS) for _ in range(300)]
    rows = [(k, " ".join(_edited(base, 0.02, rng))) for k in range(400)] + [(1000 + k, " ".join(rng.choice(WORDS) for _ in range(50))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert got == {i: 0 if i < 400 else i for i, _ in rows}
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == [0, *range(1000, 1200)]


def test_edge_rows(spark):
    rows = [(3, None), (4, ""), (5, " \t\n"), (None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a B c"), (8, "x"), (9, "long " * 70_000), (2, "long " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as root", "2 as node")
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(df).collect()), key=str)
    assert got == sorted(near_copies.brute_force(rows), key=str)
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 2, 3, 7, 8]
    assert near_copies.near_copies(df.limit(0)).count() == 0 and near_copies.keep_one(df.limit(0)).count() == 0


def test_blocks_find_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    for n in (1000, 100_000, 10_000_000):
        chosen, apart = near_copies.blocks(n), near_copies.limit(0.8, margin=0)
        found = 0
        for _ in range(300):
            bits = np.zeros(near_copies.BITS, bool)
            bits[rng.choice(near_copies.BITS, apart, False)] = True
            found += bool((~bits[chosen].any(1)).any())
        assert found >= 0.95 * 300


def _family(n, rng):
    """Texts of a likeness of about 0.43 to each other, each with a copy of 0.9 or more."""
    base = [rng.choice(WORDS) for _ in range(400)]
    rows = []
    for k in range(n):
        text = list(base)
        for at in range(0, 400, 40):
            text[at : at + 12] = [rng.choice(WORDS) for _ in range(12)]
        near = list(text)
        near[200:206] = [rng.choice(WORDS) for _ in range(6)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
    return rows


def test_copies_within_a_family_of_likeness_below_the_limit(spark):
    """Copies that are neither the smallest nor the largest of a crowded block meet; the family does not."""
    rows = _family(400, random.Random(7))
    words = [t.split() for _, t in rows[:4]]
    assert 0.38 < _likeness(words[0], words[2]) < 0.48 and _likeness(words[0], words[1]) > 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(near_copies.brute_force(rows))
    assert want == {i: i - i % 2 for i, _ in rows}
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want
    was, near_copies.CROWD = near_copies.CROWD, 32
    try:
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want
    finally:
        near_copies.CROWD = was
