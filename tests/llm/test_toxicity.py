import itertools
import random
import tracemalloc

import numpy as np
import pytest

from shorecover.llm import toxicity

DOCS = "/root/testdata/sf0.1/documents.parquet"


def test_kernel_by_definition():
    def features(word):
        word = [0, *map(toxicity._code, word), 47]
        out = {}
        for at in itertools.combinations(range(len(word)), 3):
            key = tuple(word[k] for k in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["idiot", "i-diot", "aaaa", "ab", "x", "scum", "éàé"]
    each = [features(w) for w in words]
    dot = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items())
    want = [[dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) for b in each] for a in each]
    assert np.allclose(toxicity.kernel(words, words), want)


def test_units():
    assert {"scum", "s", "a", "fine", "day", "i-d-i-o-t", "idiot"} <= toxicity.units("S c u m! a fine day, I-d-i-o-t") | {"s"}
    assert toxicity.units("") == set()
    assert all(len(w) <= toxicity.PIECE for w in toxicity.units("z" * 5000))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    labels = spark.read.parquet(DOCS.replace("documents", "labels"))
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    model = toxicity.train(docs, labels.where(f"not {held}"))
    got = toxicity.score(docs, model).join(labels.where(held), "doc_id").select("score", "toxic").collect()
    s, y = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    assert (s[y == 1] >= 0.7).mean() > 0.9
    assert (s[y == 0] >= 0.7).mean() < 0.015
    insults = model.scores(np.array([max(model.decisions(sorted(toxicity.units(t)))) for t in ("you id1ot", "s c u m", "w-o-r-t-h-l-e-s-s")]))
    assert (insults >= 0.7).all()


def test_edge_rows(spark):
    rows = [(1, "you idiot"), (2, None), (3, ""), (None, "idiot"), (4, "good day"), (4, "good day"), (5, "z" * 30_000), (6, "a fine thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as score", "1 as toxic")
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 0), (2, 1), (None, 1), (3, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    alone = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.score < 0.5 for r in toxicity.score(docs, alone).collect()} == {True}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_repeated_ids_teach_their_smallest_text(spark):
    rows = [(1, "you scum"), (1, "you idiot"), (1, "you idiot"), (2, "a fine day"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.train(docs, labels)
    want = toxicity.fit([("you idiot", 1), ("a fine day", 0)])
    words = ["idiot", "scum", "day"]
    assert np.allclose(got.decisions(words), want.decisions(words))


@pytest.mark.parametrize("texts", [[], [("x", 1)], [("", 0), ("", 1)]])
def test_tiny_samples(texts):
    assert toxicity.fit(texts) is not None


def test_fit_holds_a_word_of_many_texts_once():
    """The driver's memory follows the distinct words and not the words of all texts."""
    rng = random.Random(8)
    words = [f"wort{k}" for k in range(3000)]
    texts = [(" ".join(rng.sample(words, 300) + ["scummo"] * (k % 4 == 0)), int(k % 4 == 0)) for k in range(1500)]
    toxicity.fit(texts[:40], landmarks=8, negatives=40, rounds=0)
    tracemalloc.start()
    model = toxicity.fit(texts, landmarks=8, negatives=40, rounds=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.decisions(["scummo"])[0] > model.decisions(["wort7"])[0]
    assert peak < 24e6
