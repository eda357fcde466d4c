"""Importance resampling against a plain reading of its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorecover.llm import catalog, resampling

DIR = "/root/testdata/sf0.01"


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    """[(doc_id, n_features, weight, score)], ids in the order of the draw."""
    s, t = Counter(), Counter()
    found = [(i, *features(text)) for i, text in docs]
    for _, _, f in found:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    high, low = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * high / ((s[b] + 1.0) * low))) for b in range(10_000)]
    rows = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return [r[:4] for r in rows], [r[0] for r in fit[: 5 * len(fit) // 100]]


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("text").collect()]
    rows, drawn = brute(docs, target)
    got = catalog.op13_resampling(spark, DIR).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(rows)
    assert drawn and [r.doc_id for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


def test_odd_rows(spark):
    """Null and empty texts, a null id, repeated rows, clashing names, a text of several pieces; an empty table on either side."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["Straße", "naïve", "DATA9", "alpha", "beta", "x"]) for _ in range(n))
    long = text(250_000)
    docs = [(1, None), (2, ""), (3, long), (None, text(30)), *[(k, text(25)) for k in range(10, 300)], (5, text(19)), (7, same := text(40)), (7, same), (7, same)]
    df = spark.createDataFrame([(i, t, 1, "z", 2) for i, t in docs], "doc_id long, text string, score int, rank string, n_words int").repartition(5)
    target = [text(50), None, "ALPHA beta"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, bench).collect()
    rows, drawn = brute(docs, target)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(rows, key=key)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    kept = resampling.drawn_texts(df, bench).collect()
    assert {r.doc_id for r in kept} == {d for d in drawn if d is not None} and all(r.text for r in kept)
    assert resampling.resample(df.limit(0), bench).count() == 0
    rows, drawn = brute(docs, [])
    got = resampling.resample(df, bench.limit(0)).collect()
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn


def test_pieces_make_no_difference(monkeypatch):
    """Cut anywhere between words, a text has the same features."""
    text = ("One two, three-four 5 " * 40 + "é" * 300 + " end").encode()
    whole = sorted(np.concatenate([f for _, f in resampling.buckets(text)]).tolist())
    assert whole == sorted(features(text.decode())[1])
    for size in (1, 7, 64):
        monkeypatch.setattr(resampling, "PIECE", size)
        assert sorted(np.concatenate([f for _, f in resampling.buckets(text)]).tolist()) == whole


@pytest.mark.parametrize("per_partition", [1_000_000, 40])
def test_cutoff(spark, per_partition):
    """The exact key over many partitions, whatever is left in each, with ties of score and of whole rows."""
    rng = random.Random(2)
    keys = [(rng.randrange(-30, 30) if k % 3 else 0, rng.choice([None, *range(400)])) for k in range(2000)]
    df = spark.createDataFrame(keys, "score long, doc_id long").repartition(23)
    order = sorted(resampling.Key(-s, resampling.NO_ID if i is None else i) for s, i in keys)
    for k in (1, 2, 99, 1000, 1999, 2000):
        assert resampling.cutoff(df, k, per_partition) == order[k - 1]


def test_draws_exactly_the_share(spark):
    """Equal keys at the cut: as many as are wanted."""
    df = spark.createDataFrame([(7, 30, k, 5) for k in range(100)], "doc_id long, n_words long, n_features long, score long")
    got = resampling.draw(df, 5).where(F.col("rank").isNotNull()).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
