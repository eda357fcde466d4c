import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shorecover.llm import ngram_lm
from shorecover.llm.elias_fano import EliasFano


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=60), st.lists(st.integers(0, 2**45), max_size=30))
def test_elias_fano(values, keys):
    values = np.array(sorted(values), np.uint64)
    ef = EliasFano(values, 1 << 46)
    assert (ef.get(np.arange(len(values))) == values).all()
    keys = np.array(keys, np.uint64)
    assert (ef.successor(keys) == np.searchsorted(values, keys)).all()


def brute_force(rows, mu=ngram_lm.MU):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]) for i, t in rows]
    rest = lambda i: zlib.crc32(str(i).encode()) % 7
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, w in split:
        if i is not None and rest(i) != 2:
            uni.update(w)
            pairs = list(zip(["<s>", *w], w))
            bi.update(pairs)
            ctx.update(a for a, _ in pairs)
    n, v = sum(uni.values()), len(uni)
    base = lambda x: (uni[x] + 1) / (n + v + 1)
    out = {}
    for i, w in split:
        s = sum(math.log10(bi[a, b] / (ctx[a] + mu) + mu / (ctx[a] + mu) * base(b)) for a, b in zip(["<s>", *w], w))
        out.setdefault((i, len(w), sum(uni[x] > 0 for x in w)), []).append((i is not None and rest(i) == 2, n, sum(math.log10(base(x)) for x in w), s))
    return out


def check(df, rows):
    got = ngram_lm.score(df).collect()
    want = brute_force(rows)
    assert len(got) == len(rows)
    for r in got:
        held, n, base, s = want[r.doc_id, r.n_tokens, r.n_known][0]
        assert (r.held_out, r.train_tokens) == (held, n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert abs(r.score - s) < 0.001 * abs(s) + 2e-4 * r.n_tokens and r.score <= 0


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"W{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words[: rng.randrange(2, 40)]) for _ in range(rng.randrange(80)))) for k in range(150)]
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, "Ä b\n" * 5000), (903, "never seen at all zzz"), (905, " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as g")
    check(df, rows)
    was = ngram_lm.GROUP, ngram_lm.HOT
    try:
        for ngram_lm.GROUP, ngram_lm.HOT in ((4000, was[1]), (4000, 1.0)):  # the second: contexts are hot by the number of buckets alone
            check(df, rows)
    finally:
        ngram_lm.GROUP, ngram_lm.HOT = was
    assert ngram_lm.score(df.limit(0)).count() == 0


def test_held_out_gain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in ngram_lm.score(df).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)
    check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])


def test_elias_fano_is_compact():
    """About 2 bits an element beside the low bits, nothing unpacked; successors by definition."""
    rng = np.random.default_rng(4)
    for n, universe in ((300_000, 50_000 << 40), (100_000, 100_001), (5, 1 << 50)):
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        ef = EliasFano(values, universe)
        assert ef.nbytes <= n * (ef.low_bits + 3.4) / 8 + 400
        keys = rng.integers(0, universe, 50_000, dtype=np.uint64)
        assert (ef.successor(keys) == np.searchsorted(values, keys)).all()
        at = rng.integers(0, n, 50_000)
        assert (ef.get(at) == values[at]).all()
