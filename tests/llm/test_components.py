import random

from shorecover.llm import components


def _written(monkeypatch):
    """A list that gets an entry for each written table."""
    written, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or cut(df))
    return written


def _roots(spark, links):
    return {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}


def _by_hand(links):
    group = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in group:
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    return {x: g for x, g in group.items() if x != g}


def test_chains_cycles_and_random_links(spark):
    rng = random.Random(3)
    chain = list(range(0, -40, -1))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (201, 200), (-(2**63), 2**63 - 1)]
    links += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)]
    assert _roots(spark, links) == _by_hand(links)


def test_links_that_are_stars_are_written_once(spark, monkeypatch):
    """No round of joins runs only to see that nothing changes; each leaves plans and threads with the driver."""
    written = _written(monkeypatch)
    assert _roots(spark, []) == {} and len(written) == 1
    stars = [(9, 1), (1, 8), (8, 1), (7, 1), (5, 2), (3, 3)]
    assert _roots(spark, stars) == {9: 1, 8: 1, 7: 1, 5: 2} and len(written) == 2


def test_rounds_end_with_the_first_stars(spark, monkeypatch):
    written = _written(monkeypatch)
    assert _roots(spark, [(1, 2), (2, 3)]) == {2: 1, 3: 1} and len(written) == 2
