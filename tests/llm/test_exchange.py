"""Groups by bytes, hot ids, and the number of blobs."""

import random

from pyspark.sql import functions as F

from shorecover.llm import exchange, substring


def sizes(texts):
    return {r.g: (r.n, r.lo, r.hi) for r in texts.groupBy("g").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}


def test_groups_follow_bytes(spark):
    """A run of ids with long texts makes as many groups as its bytes need."""
    rng = random.Random(1)
    rows = [(k, "x" * (2000 if 300 <= k < 400 else rng.randrange(60))) for k in range(1000)]
    found = sizes(exchange.grouped(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=10_000).texts)
    assert max(n for n, _, _ in found.values()) < 30_000
    inside = sorted((lo, hi) for _, lo, hi in found.values())
    assert all(a[1] < b[0] for a, b in zip(inside, inside[1:]))


def test_long_texts_among_many_groups(spark):
    """The bytes of a text times the groups pass 32 bits, as those of 120 KB do from some 280 groups on."""
    rows = [(k, "x y " * (200_000 if k == 30 else 1000)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = exchange.grouped(df, group_bytes=4000)
    assert found.groups * 64 * 800_000 > 2**31
    assert sorted((lo, hi, n) for n, lo, hi in sizes(found.texts).values()) == [(k, k, len(t)) for k, t in rows]


def test_hot_and_null_ids_are_split(spark):
    """A third of all rows under one id, a third without: many groups each, and the same result as by definition."""
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(4)}" for _ in range(30))
    rows = [(50 if k % 3 == 0 else None if k % 3 == 1 else k, text()) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = exchange.grouped(df, group_bytes=2000)
    assert max(n for n, _, _ in sizes(found.texts).values()) < 10_000
    assert found.texts.where("id = 50").select("g").distinct().count() > 3 < found.texts.where("id is null").select("g").distinct().count()
    assert found.texts.where("id = 50").select("o").distinct().count() == 1
    was, exchange.grouped.__defaults__ = exchange.grouped.__defaults__, ("doc_id", "text", 2000)
    try:
        got = sorted((tuple(r) for r in substring.digest(substring.remove_repeats(df, 3)).collect()), key=str)
    finally:
        exchange.grouped.__defaults__ = was
    assert got == sorted(substring.brute_force(rows, 3), key=str)


def test_blobs_grow_with_the_input():
    """A group sends no empty blob, so there are never more blobs than hashes, and groups x buckets grows as the input while groups do."""
    import numpy as np
    import pyarrow as pa

    from shorecover.llm import ngram_lm

    table = pa.table({"id": pa.array([1, 2], pa.int64()), "text": pa.array(["a b c", "d"])})
    sent = ngram_lm._Group(table, 10_000, 7, 2, np.zeros(0, np.uint64)).blobs(10_000)
    assert len(sent) <= 2 * 6
    counts = []
    for gb in (1, 4, 16, 64):
        groups = gb * 1e9 / (exchange.GROUP_BYTES * min(exchange.GROW, max(1.0, gb**0.5)))
        counts.append(groups**2 / gb)
    assert max(counts) < 1.1 * min(counts)


def test_relays_give_what_direct_blobs_give(spark, monkeypatch):
    """Both users of the exchange, groups of many sizes, hot and null ids."""
    from shorecover.llm import ngram_lm

    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(40)))
    rows = [(50 if k % 3 == 0 else None if k % 7 == 1 else k, text() if k % 11 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(exchange.grouped, "__defaults__", ("doc_id", "text", 800))
    monkeypatch.setattr(exchange.spread, "__defaults__", ("doc_id", "text", 800))
    assert exchange.grouped(df).groups > 20
    runs = []
    for most in (10**9, 4):
        monkeypatch.setattr(exchange, "DIRECT", most)
        runs.append((sorted(map(str, substring.remove_repeats(df, 3).collect())), sorted(map(str, ngram_lm.score(df).collect()))))
    assert runs[0] == runs[1] and len(runs[0][0]) == len(runs[0][1]) == 300
    got = [tuple(r) for r in substring.digest(substring.remove_repeats(df, 3)).collect()]
    assert sorted(got, key=str) == sorted(substring.brute_force(rows, 3), key=str)
    assert exchange._relayed(exchange.grouped(df.limit(0)), None, None, None, "x long", 2).count() == 0


def test_rows_of_relays_stay_large():
    """From 64 GB to 100 TB a row of a relay holds over 10 KB of a group's some 11 million windows of 6 bytes, a relay about what a group sends."""
    for tb in (0.064, 1, 10, 100):
        groups = tb * 1e12 / (exchange.GROUP_BYTES * exchange.GROW)
        a_group_sends = exchange.GROUP_BYTES * exchange.GROW / 6 * 6
        a_row = a_group_sends / groups**0.5
        assert a_row > 10_000 and a_row * groups**0.5 < 100e6


def test_items_of_a_sheaf():
    items = [(3, 1, 0, b""), (2**30, 5, -1, b"abc"), (0, 0, 0, bytes(300))]
    assert list(exchange._items(exchange._sheaf(items))) == items and list(exchange._items(exchange._sheaf([]))) == []
