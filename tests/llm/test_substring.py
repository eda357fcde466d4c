from shorecover.llm import substring


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(4)) for _ in range(60)) for _ in range(6)]
    rows = [(k, base[k % 6] + " " + base[(k * 5 + 1) % 6]) for k in range(30)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "a b c"), (None, base[0]), (7, base[2]), (7, base[2]), (104, ("x y z " * 4000)), (105, "ß é " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'u' as id", "1 as g", "2 as b")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in substring.digest(substring.remove_repeats(df)).collect()), key=key)
    assert got == sorted(substring.brute_force(rows), key=key)


def test_groups_and_empty(spark):
    from shorecover.llm import exchange

    rows = [(k, " ".join(f"w{(j * (k % 5 + 1)) % 97}" for j in range(120))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was, exchange.grouped.__defaults__ = exchange.grouped.__defaults__, ("doc_id", "text", 4000)
    try:
        got = sorted(tuple(r) for r in substring.digest(substring.remove_repeats(df)).collect())
    finally:
        exchange.grouped.__defaults__ = was
    assert got == sorted(substring.brute_force(rows))
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_a_long_text_among_many_groups(spark, monkeypatch):
    """The bytes of the long text times the groups pass 32 bits."""
    from shorecover.llm import exchange

    rows = [(k, " ".join(f"w{(j * (k % 7 + 1)) % 997}" for j in range(90_000 if k == 20 else 400))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(exchange.grouped, "__defaults__", ("doc_id", "text", 3000))
    assert exchange.grouped(df).groups * 64 * len(rows[20][1]) > 2**31
    got = sorted(tuple(r) for r in substring.digest(substring.remove_repeats(df)).collect())
    assert got == sorted(substring.brute_force(rows))
