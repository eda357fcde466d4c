import re

import numpy as np

from shorecover.llm import decontamination as D

ITEMS = [
    (1, "When Anna has 12 apples and gives 5 of them to Tom, how many apples does Anna have left after she walks 3 km home?"),
    (2, "the quick brown fox jumps over the lazy dog and then sleeps under an old tall tree by the river until noon"),
    (3, "short item here"),
    (4, None),
    (5, ""),
]
FILL = "some plain words about nothing in particular that fill the page. "


def docs():
    one, two = ITEMS[0][1], ITEMS[1][1]
    other = re.sub("12", "40", re.sub(r"\b5\b", "7", one)).replace("Anna", "Berta").replace("Tom", "Karl")
    mixed = one.replace("does Anna", "does Carla")
    part = " ".join(two.split()[3:18])
    few = " ".join(two.split()[3:14])
    return [(10, FILL * 3 + one + " " + FILL), (11, FILL + "so Bert said. " + other + " " + FILL), (12, FILL + mixed), (13, FILL + part.upper().lower() + ", " + FILL), (14, FILL + few + " " + FILL), (15, FILL * 50), (16, None), (17, ""), (None, two), (18, "Short item here."), (19, FILL + "short item here"), (13, two)]


def test_planted(spark):
    d = spark.createDataFrame(docs(), "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as h", "3 as pos")
    b = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r.doc_id, r.item_id): r.exact for r in D.leaks(d, b).collect()}
    assert got == {(10, 1): True, (11, 1): False, (13, 2): True, (18, 3): True}
    assert {r.doc_id for r in D.without_leaks(d, b).collect()} == {12, 14, 15, 16, 17, 19}
    assert D.leaks(d.limit(0), b).count() == D.leaks(d, b.limit(0)).count() == 0


def test_shuffled_join_gives_the_same(spark):
    d = spark.createDataFrame(docs(), "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, D.leaks(d, b).collect()))
    was, D.LOCAL_WINDOWS = D.LOCAL_WINDOWS, 0
    try:
        assert sorted(map(tuple, D.leaks(d, b).collect())) == want
    finally:
        D.LOCAL_WINDOWS = was


def test_exact_passages_by_brute_force(spark):
    """At sf0.01: documents that hold 20 words of an item in a row leak it; no document without 8 does."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    norm = lambda t: [re.sub(r"^[^\w]+|[^\w]+$", "", w).lower() for w in t.split()]
    items = {r.item_id: norm(r.text) for r in b.collect()}
    grams = {}
    for size in (8, 20):
        for i, w in items.items():
            for k in range(len(w) - size + 1):
                grams.setdefault((size, tuple(w[k : k + size])), set()).add(i)
    sure, maybe = set(), set()
    for r in d.collect():
        w = norm(r.text)
        for size, out in ((8, maybe), (20, sure)):
            for k in range(len(w) - size + 1):
                out |= {(r.doc_id, i) for i in grams.get((size, tuple(w[k : k + size])), ())}
    got = {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()}
    assert sure <= got <= maybe and len(sure) > 3


LONG = "A farmer named Peter keeps 30 hens and sells the eggs every morning at the market in the old town where his sister runs a small stall and each week Peter puts 30 coins aside because he wants to buy a second barn before the cold winter comes and the hens need more room"
DENSE = "On Monday Alice Brown met Carl Davis and Emma Fox at 10 12 14 16 18 20 22 24 26 28 in Paris"
PAIR = "The shop sells 3 red kites and 5 blue kites to the children who play on the wide green field"


def test_parts_and_low_plain_copies(spark):
    """What is word for word leaks beside a changed slot, in capitals and among numbers; two values may become one."""
    items = [(1, LONG), (2, DENSE), (3, PAIR)]
    rows = [
        (20, FILL + LONG.replace("week Peter", "week Karl") + " " + FILL),
        (21, FILL + LONG.replace("puts 30", "puts 31") + " " + FILL),
        (22, FILL + LONG.upper() + " " + FILL),
        (23, FILL + LONG.title() + " " + FILL),
        (24, FILL + DENSE + " " + FILL),
        (25, FILL + PAIR.replace("3", "4").replace("5", "4") + " " + FILL),
        (26, FILL + DENSE.replace("1", "3").replace("2", "5") + " " + FILL),
        (27, FILL * 9),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in D.leaks(d, b).collect()}
    assert got == {(20, 1): True, (21, 1): True, (22, 1): True, (23, 1): True, (24, 2): True, (25, 3): False}


def test_spelled_out_numbers_are_slots(spark):
    item = "A farmer has seven red apples and then buys nine more green ones from the old market near the river how many"
    docs = [(1, item), (2, item.replace("seven", "six").replace("nine", "four")), (3, "nothing of the kind is said in this text about a farmer")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.exact, r.n_slots) for r in D.leaks(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got == {1: (True, 2), 2: (False, 2)}


def test_rows_without_an_id_are_judged(spark):
    item = "Which of these nineteen rivers runs through the greatest number of countries on its way down to the wide open sea"
    df = spark.createDataFrame([(None, item), (None, "clean words only"), (1, item), (2, None), (None, None)], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as h")
    kept = D.without_leaks(df, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(None, "clean words only"), (2, None), (None, None)]))


def test_shared_openings_make_no_pairs(spark, monkeypatch):
    """Documents and items that share a templated opening and nothing else never meet; true passages beside it are found."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, 7))
    opening = "how many of the 12 coins does Anna hold"
    items = [(k, f"{opening} {' '.join(word() for _ in range(30))}") for k in range(200)]
    docs = [(k, f"{opening} {' '.join(word() for _ in range(60))}") for k in range(200)]
    docs += [(900, f"{docs[0][1]} {' '.join(items[5][1].split()[9:29])}"), (901, f"{word()} {items[7][1]}")]
    made = []
    real = D.cut
    monkeypatch.setattr(D, "cut", lambda df: made.append(real(df)) or made[-1])
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.n_words for r in found.collect()}
    assert got == {(900, 5): 20, (901, 7): 39}
    assert max(df.count() for df in made) < 10 * len(docs)
