"""Overlapping slices of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import IMAGE


def _content(size: int, padding: int) -> int:
    if size - 2 * padding <= 0:
        raise ValueError("the padding leaves no content in a slice")
    return size - 2 * padding


def _tiles(length: str, size: int, step: int) -> Column:
    """How many tiles cover a length."""
    return F.when(F.col(length) <= size, 1).otherwise(1 + F.ceil((F.col(length) - size) / step)).cast("int")


def plan_slices(images: DataFrame, size: int = 1024, overlap: float = 0.2, padding: int = 0) -> DataFrame:
    """images: image, height, width. Columns image, slice_id, x0, y0, x1, y1, row by row; a tile that would pass the edge moves back to it."""
    size = _content(size, padding)
    step = size - int(overlap * size)
    rows = images.withColumns({"ny": _tiles("height", size, step), "nx": _tiles("width", size, step)})
    rows = rows.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    start = lambda i, length: F.greatest(F.lit(0), F.least(F.col(i) * step, F.col(length) - size))
    rows = rows.withColumns({"x0": start("ix", "width"), "y0": start("iy", "height"), "slice_id": F.col("iy") * F.col("nx") + F.col("ix")})
    return rows.select(IMAGE, "slice_id", "x0", "y0", F.least(F.col("x0") + size, "width").alias("x1"), F.least(F.col("y0") + size, "height").alias("y1"))


def _covering(v: str, length: str, size: int, step: int) -> Column:
    """The tiles along one axis that hold a coordinate: at most three, found by arithmetic."""
    n = _tiles(length, size, step)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col(v) - size) / step).cast("int")), F.least(n - 1, F.floor(F.col(v) / step).cast("int")))
    start = lambda k: F.greatest(F.lit(0), F.least(k * step, F.col(length) - size))
    return F.filter(F.array_distinct(F.concat(near, F.array(n - 1))), lambda k: (start(k) <= F.col(v)) & (F.col(v) < start(k) + size))


def assign_slices(pixels: DataFrame, images: DataFrame, size: int = 1024, overlap: float = 0.2, padding: int = 0) -> DataFrame:
    """Each pixel once for each slice that holds it, with slice_id, x0, y0, x1, y1: no range join, one join on the image."""
    size = _content(size, padding)
    step = size - int(overlap * size)
    rows = pixels.join(images, IMAGE)
    rows = rows.withColumn("iy", F.explode(_covering("y", "height", size, step))).withColumn("ix", F.explode(_covering("x", "width", size, step)))
    start = lambda i, length: F.greatest(F.lit(0), F.least(F.col(i) * step, F.col(length) - size))
    rows = rows.withColumns({"x0": start("ix", "width"), "y0": start("iy", "height"), "slice_id": (F.col("iy") * _tiles("width", size, step) + F.col("ix")).cast("int")})
    return rows.withColumns({"x1": F.least(F.col("x0") + size, "width"), "y1": F.least(F.col("y0") + size, "height")}).drop("ix", "iy", "height", "width")


def pad_slices(rows: DataFrame, padding: int) -> DataFrame:
    """Pixels of slices in padded coordinates (sy, sx), with a border: green in the picture, zero in LAB."""
    inner = rows.select(IMAGE, "slice_id", (F.col("y") - F.col("y0") + padding).alias("sy"), (F.col("x") - F.col("x0") + padding).alias("sx"), "r", "g", "b", "L", "a", "b_")
    if not padding:
        return inner
    shapes = rows.groupBy(IMAGE, "slice_id").agg(F.first(F.col("y1") - F.col("y0")).alias("h"), F.first(F.col("x1") - F.col("x0")).alias("w"))
    border = shapes.withColumn("sy", F.explode(F.sequence(F.lit(0), F.col("h") + 2 * padding - 1))).withColumn("sx", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * padding - 1)))
    inside = (F.col("sy") >= padding) & (F.col("sy") < F.col("h") + padding) & (F.col("sx") >= padding) & (F.col("sx") < F.col("w") + padding)
    green = [F.lit(v).alias(c) for c, v in (("r", 0), ("g", 255), ("b", 0), ("L", 0.0), ("a", 0.0), ("b_", 0.0))]
    return inner.unionByName(border.where(~inside).select(IMAGE, "slice_id", "sy", "sx", *green))


def with_border(rows: DataFrame, padding: int) -> DataFrame:
    """Pixels of slices (with L, a, b_ and water colour) and their border of zeros: y0, x0, y1, x1 grow by the padding."""
    if not padding:
        return rows
    grown = rows.withColumns({"y0": F.col("y0") - padding, "x0": F.col("x0") - padding, "y1": F.col("y1") + padding, "x1": F.col("x1") + padding})
    kept = ["water_l", "water_a", "water_b"]
    frames = grown.groupBy(IMAGE, "slice_id", "y0", "x0", "y1", "x1").agg(*[F.first(c).alias(c) for c in kept])
    every = frames.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    inside = F.expr(f"y >= y0 + {padding} and y < y1 - {padding} and x >= x0 + {padding} and x < x1 - {padding}")
    border = every.where(~inside).withColumns({c: F.lit(0.0) for c in ("L", "a", "b_")})
    columns = [IMAGE, "slice_id", "y", "x", "y0", "x0", "y1", "x1", "L", "a", "b_", *kept]
    return grown.select(*columns).unionByName(border.select(*columns))


def unpad_masks(masks: DataFrame, slices: DataFrame, padding: int) -> DataFrame:
    """Masks in padded slice coordinates (sy, sx) to image coordinates, without the border."""
    rows = masks.join(slices, [IMAGE, "slice_id"]).withColumns({"y": F.col("y0") + F.col("sy") - padding, "x": F.col("x0") + F.col("sx") - padding})
    return rows.where("y >= y0 and y < y1 and x >= x0 and x < x1").select(IMAGE, "slice_id", "y", "x", "is_water")
