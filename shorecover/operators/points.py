"""Prompt points of slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import SLICE
from .ranks import first_by_hash
from .survey import order_hash, uniform

KEYS = (*SLICE, "sy", "sx")


def one_per_cell(points: DataFrame, grid_size: int = 64, seed: int = 0) -> DataFrame:
    """One random candidate for each cell y // g, x // g of a slice, with its cell_id: a minimum of hashes, no sort."""
    g = grid_size
    cell = F.expr(f"int((sy div {g}) * ((w + {g} - 1) div {g}) + sx div {g})")
    others = [c for c in points.columns if c not in (*SLICE, "cell_id")]
    rows = points.withColumns({"cell_id": cell, "__o": order_hash(seed, *KEYS)})
    first = rows.groupBy(*SLICE, "cell_id").agg(F.min_by(F.struct(*others), F.struct("__o", "sy", "sx")).alias("p"))
    return first.select(*SLICE, "cell_id", *[F.col(f"p.{c}").alias(c) for c in others])


def require_points(filtered: DataFrame, candidates: DataFrame, num_points: int = 3) -> DataFrame:
    """The filtered candidates of slices with at least num_points initial ones."""
    enough = candidates.groupBy(*SLICE).count().where(F.col("count") >= num_points).select(*SLICE)
    return filtered.join(enough, SLICE, "left_semi")


def choose_points(points: DataFrame, strategy: str = "random", num_points: int = 3, seed: int = 0, slice_size: int = 1024) -> DataFrame:
    """At most num_points points of each slice, as image, slice_id, x, y in slice coordinates.

    random: a reproducible choice. center_bias: without replacement, weights 1/(distance to the
    centre + 1e-6), by exponential keys. poisson_disk: see poisson_disk().
    """
    if strategy == "poisson_disk":
        return poisson_disk(points, num_points, seed, slice_size)
    key = order_hash(seed, *KEYS)
    if strategy == "center_bias":
        far = F.sqrt(F.pow(F.col("sy") - F.col("h") / 2, F.lit(2.0)) + F.pow(F.col("sx") - F.col("w") / 2, F.lit(2.0))) + 1e-6
        key = -F.log(uniform(seed, *KEYS) + 2.0**-33) * far
    w = Window.partitionBy(*SLICE).orderBy(key, "sy", "sx")
    return points.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= num_points).select(*SLICE, F.col("sx").alias("x"), F.col("sy").alias("y"))


def poisson_disk(points: DataFrame, num_points: int = 3, seed: int = 0, slice_size: int = 1024, tries: int = 30) -> DataFrame:
    """Of n = min(num_points, candidates) points, those that lie at least slice_size * sqrt(2) / (2 n) apart: a random first one, then up to `tries` random candidates for each further one.

    Random is the order of the candidates' MD5; a candidate is tried once, and `tries` refused in a
    row end the choice. May give fewer than n, also in a slice of few candidates. At most
    1 + tries * (num_points - 1) candidates of a slice are ever tried, so only those are gathered.
    """
    most = 1 + tries * (num_points - 1)
    if num_points < 1:
        return points.limit(0).select(*SLICE, F.col("sx").alias("x"), F.col("sy").alias("y"))
    order = Window.partitionBy(*SLICE).orderBy(order_hash(seed, *KEYS), "sy", "sx")
    tried = points.select(*SLICE, "sy", "sx", F.row_number().over(order).alias("k")).where(F.col("k") <= most)
    lists = tried.groupBy(*SLICE).agg(F.array_sort(F.collect_list(F.struct("k", "sy", "sx"))).alias("c"))
    lists = lists.withColumn("n", F.least(F.lit(num_points), F.size("c")).cast("bigint"))
    # 4 n^2 d^2 > 2 size^2, in whole numbers
    square = lambda v: v.cast("bigint") * v.cast("bigint")
    lie_apart = lambda p, q: 4 * F.col("n") * F.col("n") * (square(p["sy"] - q["sy"]) + square(p["sx"] - q["sx"])) > 2 * slice_size**2

    def step(state: Column, p: Column) -> Column:
        over = (F.size(state["chosen"]) >= F.col("n")) | (state["refused"] >= tries)
        far = ~over & F.forall(state["chosen"], lambda q: lie_apart(p, q))
        chosen = F.when(far, F.concat(state["chosen"], F.array(p))).otherwise(state["chosen"])
        refused = F.when(far, 0).when(over, state["refused"]).otherwise(state["refused"] + 1)
        return F.struct(chosen.alias("chosen"), refused.cast("int").alias("refused"))

    start = F.struct(F.slice("c", 1, 1).alias("chosen"), F.lit(0).alias("refused"))
    found = F.aggregate(F.expr("slice(c, 2, size(c))"), start, step, lambda s: s["chosen"])
    return lists.select(*SLICE, F.explode(found).alias("p")).select(*SLICE, F.col("p.sx").alias("x"), F.col("p.sy").alias("y"))


def apart(at: np.ndarray, num_points: int, slice_size: int, rng: np.random.Generator, tries: int = 30) -> list[int]:
    """The indexes of the points chosen of at (y, x) by the rule of poisson_disk(), candidates drawn by rng instead, with repeats: the form for one slice in a task."""
    n = min(num_points, len(at))
    if not n:
        return []
    least = slice_size**2 * 2 / (n**2 * 4)
    chosen = [int(rng.integers(len(at)))]
    while len(chosen) < n:
        drawn = rng.integers(0, len(at), tries)
        far = (((at[drawn][:, None] - at[chosen]) ** 2).sum(2) > least).all(1)
        if not far.any():
            break
        chosen.append(int(drawn[far.argmax()]))
    return chosen


def sample_per_cell(candidates: DataFrame, cells: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """Up to n candidates of each valid cell (cy, cx). Only those under a threshold on their hash, somewhat more than n a cell, are ranked."""
    valid = cells.where("is_valid").select(*SLICE, "cy", "cx")
    return first_by_hash(candidates.join(valid, [*SLICE, "cy", "cx"], "left_semi"), [*SLICE, "cy", "cx"], n, order_hash(seed, *KEYS), ["sy", "sx"])
