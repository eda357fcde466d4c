"""Grid cells of slices: moments, flags, shortcuts, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import distance
from .pixels import IMAGE

SLICE = [IMAGE, "slice_id"]


def cell_stats(rows: DataFrame, grid_size: int = 64) -> DataFrame:
    """rows: pixels of slices with L, a, b_. For each whole cell: n, mean_l, mean_a, mean_b, std_l (population); ragged edges are left out."""
    g = grid_size
    keyed = rows.withColumns({"cy": F.expr(f"int((y - y0) div {g})"), "cx": F.expr(f"int((x - x0) div {g})")})
    keyed = keyed.where(f"cy < (y1 - y0) div {g} and cx < (x1 - x0) div {g}")
    moments = keyed.groupBy(*SLICE, "cy", "cx").agg(F.count("*").alias("n"), F.avg("L").alias("mean_l"), F.avg("a").alias("mean_a"), F.avg("b_").alias("mean_b"), F.avg(F.col("L") * F.col("L")).alias("sq"))
    return moments.withColumn("std_l", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean_l") * F.col("mean_l")))).drop("sq")


def cell_flags(cells: DataFrame, uniform_std: float = 4.0, threshold_max: float = 20) -> DataFrame:
    """is_uniform, is_water, is_valid (both) of cells with water_l, water_a, water_b."""
    rows = cells.withColumns({"is_uniform": F.col("std_l") <= uniform_std, "is_water": distance("mean_l", "mean_a", "mean_b") <= threshold_max})
    return rows.withColumn("is_valid", F.col("is_uniform") & F.col("is_water"))


def with_cell_category(cells: DataFrame) -> DataFrame:
    return cells.withColumn("category", F.when(F.col("is_valid"), "green").when(F.col("is_uniform"), "purple").otherwise("red"))


def slice_shortcut(cells: DataFrame, uniform_share: float = 0.98, water_share: float = 0.98) -> DataFrame:
    """For each slice with cells: uniform_pct, water_pct and whether it is water as a whole."""
    shares = cells.groupBy(*SLICE).agg(F.avg(F.col("is_uniform").cast("int")).alias("uniform_pct"), F.avg(F.col("is_water").cast("int")).alias("water_pct"))
    return shares.withColumn("shortcut", (F.col("uniform_pct") >= uniform_share) & (F.col("water_pct") >= water_share))


def slice_fallback(rows: DataFrame, brightness: float = 100.0, max_distance: float = 55.0) -> DataFrame:
    """For each slice: all_water if its mean L is over `brightness` and its mean distance under `max_distance`. At the default no L reaches it."""
    means = rows.groupBy(*SLICE).agg(F.avg("L").alias("mean_l"), F.avg(distance()).alias("mean_distance"))
    return means.withColumn("all_water", (F.col("mean_l") > brightness) & (F.col("mean_distance") < max_distance))


def candidate_pixels(rows: DataFrame, cells: DataFrame, grid_size: int = 64) -> DataFrame:
    """Pixels in valid cells, where a pixel belongs to the cell of nearest upsampling: floor(y * cells / height)."""
    g = grid_size
    keyed = rows.withColumns({"sy": F.col("y") - F.col("y0"), "sx": F.col("x") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "w": F.col("x1") - F.col("x0")})
    keyed = keyed.where(f"h >= {g} and w >= {g}").withColumns({"cy": F.expr(f"int((sy * (h div {g})) div h)"), "cx": F.expr(f"int((sx * (w div {g})) div w)")})
    valid = cells.where("is_valid").select(*SLICE, "cy", "cx")
    return keyed.join(valid, [*SLICE, "cy", "cx"], "left_semi").select(*SLICE, "sy", "sx", "h", "w", "cy", "cx")


def pixel_candidates(rows: DataFrame, threshold: float = 20) -> DataFrame:
    """Pixels within the threshold of the water colour: the candidates where cells are not judged."""
    keyed = rows.where(distance() <= threshold).withColumns({"sy": F.col("y") - F.col("y0"), "sx": F.col("x") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "w": F.col("x1") - F.col("x0")})
    return keyed.select(*SLICE, "sy", "sx", "h", "w")


def slice_diagnostics(cells: DataFrame, candidates: DataFrame, filtered: DataFrame, points: DataFrame, threshold: float = 20, slices: DataFrame | None = None) -> DataFrame:
    """Per slice: cells by category, candidates, candidates left one a cell, points, and the threshold used (null without candidates). slices: all there are (image, slice_id); without it those with cells."""
    count = lambda name: F.count_if(F.col("category") == name).alias(f"n_{name}")
    out = with_cell_category(cells).groupBy(*SLICE).agg(F.count("*").alias("n_cells"), count("green"), count("purple"), count("red"))
    if slices is not None:
        out = slices.select(*SLICE).join(out, SLICE, "left").na.fill(0, ["n_cells", "n_green", "n_purple", "n_red"])
    for rows, name in ((candidates, "n_candidates"), (filtered, "n_filtered"), (points, "n_points")):
        out = out.join(rows.groupBy(*SLICE).agg(F.count("*").alias(name)), SLICE, "left").na.fill({name: 0})
    return out.withColumn("threshold_used", F.when(F.col("n_candidates") > 0, F.lit(float(threshold))))
