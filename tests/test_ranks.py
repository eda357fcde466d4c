"""Ranks within groups that no task holds."""

import hashlib
import random

from pyspark.sql import functions as F

from shorecover.operators import pixels, ranks, survey
from shorecover.operators.ranks import ranked


def test_ranks_equal_sorting(spark):
    """A hot group, ties, null keys and null orders, several partitions: the places of a sort."""
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, o int").repartition(7)
    got = ranked(df, ["g"], [F.col("o").desc_nulls_last()]).collect()
    assert len(got) == len(rows)
    for g in ("hot", "a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["__n"])
        assert [r["__n"] for r in mine] == list(range(len(mine))) and {r["__all"] for r in mine} == {len(mine)}
        order = [-1 if r.o is None else r.o for r in mine]
        assert order == sorted(order, reverse=True)
    whole = sorted(ranked(df, [], ["k"]).collect(), key=lambda r: r["__n"])
    assert [r.k for r in whole] == list(range(3000)) and whole[0]["__all"] == 3000
    assert ranked(df.limit(0), ["g"], ["o"]).count() == 0


def test_a_hot_group_lies_in_many_partitions(spark):
    """No window or group of the plan takes more rows of a location than there are partitions, and slices are those of a list."""
    df = spark.range(20_000).select(F.col("id").alias("image_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("location"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(df, ["location"], ["image_id"])
        files = got.select("image_id").where("location = 'hot'").withColumn("p", F.spark_partition_id()).select("p").distinct().count()
        assert files > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = survey.slice_per_location(df, 5, -7)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and all("__rows" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window"))
    ids = {loc: [k for k in range(20_000) if (k % 10 < 9) == (loc == "hot")] for loc in ("hot", "cold")}
    for start, end in ((5, -7), (None, 4), (-3, None), (0, -30_000), (2, 2)):
        got = survey.slice_per_location(df, start, end).collect()
        for loc, want in ids.items():
            assert sorted(r.image_id for r in got if r.location == loc) == want[slice(start, max(end, -len(want)) if end is not None and end < 0 else end)]


def test_first_by_hash_equals_sorting(spark):
    """Groups of all sizes, a null one, a hot one, repeated rows; the same rows as a sort gives, whatever the threshold."""
    rng = random.Random(6)
    rows = [("hot", k) for k in range(5000)] + [("small", k) for k in range(7)] + [(None, k) for k in range(60)] + [("twice", 1)] * 30
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    digest = lambda g, k: hashlib.md5("|".join(["3", *([] if g is None else [g]), str(k)]).encode()).hexdigest()
    for n in (1, 10, 300):
        want = []
        for g in ("hot", "small", None, "twice"):
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (digest(*r), r[1]))[:n]
        got = ranks.first_by_hash(df, ["g"], n, survey.order_hash(3, "g", "k"), ["k"])
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert ranks.first_by_hash(df.limit(0), ["g"], 3, survey.order_hash(3, "g", "k"), ["k"]).count() == 0


def test_a_low_threshold_is_made_good(spark, monkeypatch):
    """Where too few rows pass, further rounds complete the group."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id")
    order = survey.order_hash(1, "id")
    want = sorted(map(tuple, ranks.first_by_hash(df, ["g"], 50, order, ["id"]).collect()))
    monkeypatch.setattr(ranks, "threshold", lambda n, total: F.lit(n) / total / 3)
    assert sorted(map(tuple, ranks.first_by_hash(df, ["g"], 50, order, ["id"]).collect())) == want and len(want) == 150


def test_under_two_n_rows_are_ranked(spark, monkeypatch):
    """Of an image of 120,000 pixels, 2000 wanted: what reaches the window is under 4000 rows."""
    seen = []
    real = ranks.cut
    monkeypatch.setattr(ranks, "cut", lambda df: seen.append(real(df)) or seen[-1])
    px = spark.range(120_000).select(F.lit("i").alias("image"), (F.col("id") / 400).cast("int").alias("y"), (F.col("id") % 400).cast("int").alias("x"))
    got = pixels.sample_pixels(px, 2000, 1)
    assert got.count() == 2000 and 2000 <= seen[1].count() < 4000
    window = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith("Relation")]
    assert len(window) == 1 and "__h" in window[0]  # the written rows under the threshold, not the pixels
