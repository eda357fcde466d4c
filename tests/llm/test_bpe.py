import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from shorecover.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def expected(text):
    t = TOKENIZER
    ids = t.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_equals_the_library(spark):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2009", "\u3000", "\u200b", "\ufeff", "\u180e", "it's", "we'LL", "don't", "é", "ß", "漢字", "\xb2", "\xbd", "\u0663", "12", "3.5", "_", "---", "<|endoftext|>", "<|", "\U0001f642", "e\u0301", "\u200d", "\ufffd", "abc", "The", "\x00"]
    texts = [None, "", " ", "\n\n x", "a" * 5000, "x  <|endoftext|>  y", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400))]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    spec = bpe.load(spark, PATH)
    got = {r[0]: tuple(r[1:]) for r in bpe.digest(bpe.decode(bpe.encode(df, spec), spec)).collect()}
    assert {k: expected(t) for k, t in rows} == got
    assert bpe.digest(bpe.decode(bpe.encode(df.limit(0), spec), spec)).count() == 0


def test_many_groups_and_buckets_and_edge_rows(spark):
    """Repeated rows and ids, null ids, a very long text; units of many groups and buckets, each encoded once."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgé ") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    rows = [(k % 50 if k % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))) for k in range(300)]
    rows += rows[:20] + [(1000, " ".join(rng.choice(words) for _ in range(60_000))), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g", "2 as b", "3 as blob").repartition(5)
    was, (bpe.GROUP, bpe.BUCKET) = (bpe.GROUP, bpe.BUCKET), (20_000, 50_000)
    try:
        spec = bpe.load(spark, PATH)
        got = sorted((tuple(r) for r in bpe.digest(bpe.decode(bpe.encode(df, spec), spec)).collect()), key=str)
    finally:
        bpe.GROUP, bpe.BUCKET = was
    assert got == sorted(((i, *expected(t)) for i, t in rows), key=str)


def test_rows_in_another_order_each_time_they_are_read(spark):
    """As after a shuffle whose blocks arrive in another order: repeated ids, rows and null ids too."""
    rng = random.Random(7)
    rows = [(k % 60 if k % 9 else None, " ".join(rng.choice(["ab", "cd", "é", "f  g"]) + str(rng.randrange(99)) for _ in range(30))) for k in range(400)]
    rows += rows[:30]

    def shuffled(batches):
        import os

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng(int.from_bytes(os.urandom(8), "little")).permutation(batch.num_rows)))

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(shuffled, "doc_id long, text string")
    was, (bpe.GROUP, bpe.BUCKET) = (bpe.GROUP, bpe.BUCKET), (3000, 8000)
    try:
        spec = bpe.load(spark, PATH)
        got = sorted((tuple(r) for r in bpe.digest(bpe.decode(bpe.encode(df, spec), spec)).collect()), key=str)
    finally:
        bpe.GROUP, bpe.BUCKET = was
    assert got == sorted(((i, *expected(t)) for i, t in rows), key=str)
