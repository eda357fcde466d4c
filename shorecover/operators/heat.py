"""The georeferenced grid of area-weighted coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import CELL, RADIUS, disc_cell_area


#: A common area up to this many square metres is rounding, not overlap.
LEAST_AREA = 1e-9


def total_bounds(points: DataFrame, r: float = RADIUS, by: tuple[str, ...] = ()) -> DataFrame:
    """min_x, min_y, max_x, max_y of the discs around cx, cy: one row (a group)."""
    return points.groupBy(*by).agg((F.min("cx") - r).alias("min_x"), (F.min("cy") - r).alias("min_y"), (F.max("cx") + r).alias("max_x"), (F.max("cy") + r).alias("max_y"))


def _counts(cell: float):
    return F.ceil((F.col("max_x") - F.col("min_x")) / cell).cast("long"), F.ceil((F.col("max_y") - F.col("min_y")) / cell).cast("long")


def _boxed(df: DataFrame, cell: float) -> DataFrame:
    x0, y0 = F.col("min_x") + F.col("ix") * cell, F.col("min_y") + F.col("iy") * cell
    return df.withColumns({"grid_id": F.col("ix") * F.col("ny") + F.col("iy"), "x0": x0, "y0": y0, "x1": x0 + cell, "y1": y0 + cell})


#: Cells of a row of make_grid() before they are rows, at least; beyond, a millionth of all.
RUN = 4096


def make_grid(bounds: DataFrame, cell: float = CELL) -> DataFrame:
    """Every square of `cell` metres from the least corner: grid_id, ix, iy, x0, y0, x1, y1.

    The row of bounds becomes runs of grid ids (at most a million), dealt to all tasks, and only there cells, whose ix and iy follow from the id.
    """
    nx, ny = _counts(cell)
    rows = bounds.withColumns({"nx": nx, "ny": ny}).where("nx > 0 and ny > 0")
    rows = rows.withColumn("__all", F.col("nx") * F.col("ny"))
    rows = rows.withColumn("__run", F.greatest(F.lit(RUN), F.ceil(F.col("__all") / 1e6)).cast("bigint"))
    rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__all") - 1, "__run")))
    # a number of partitions that is asked for isn't lowered for small rows, and these grow
    rows = rows.repartition(int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__from")
    rows = rows.withColumn("grid_id", F.explode(F.sequence("__from", F.least(F.col("__from") + F.col("__run"), F.col("__all")) - 1)))
    rows = rows.withColumns({"ix": F.expr("grid_id div ny"), "iy": F.col("grid_id") % F.col("ny")})
    return _boxed(rows, cell).select(*[c for c in bounds.columns if c not in ("min_x", "min_y", "max_x", "max_y")], "grid_id", "ix", "iy", "x0", "y0", "x1", "y1")


def overlay(points: DataFrame, bounds: DataFrame, cell: float = CELL, r: float = RADIUS, by: tuple[str, ...] = ()) -> DataFrame:
    """Each (disc, cell) pair with a positive common area. The at most 9 cells that a disc can meet follow from its centre; no cell is searched for.

    Bounds are one row (a group), so their join is a broadcast of a single row unless `by` is given.
    """
    nx, ny = _counts(cell)
    given = bounds.withColumns({"nx": nx, "ny": ny})
    rows = points.where("cx is not null and cy is not null")
    rows = rows.join(given, list(by)) if by else rows.join(F.broadcast(given), F.lit(True))
    at = lambda c, low, n, d: F.least(F.greatest(F.floor((F.col(c) + d - F.col(low)) / cell), F.lit(0)), F.col(n) - 1)
    rows = rows.withColumn("ix", F.explode(F.sequence(at("cx", "min_x", "nx", -r), at("cx", "min_x", "nx", r))))
    rows = rows.withColumn("iy", F.explode(F.sequence(at("cy", "min_y", "ny", -r), at("cy", "min_y", "ny", r))))
    rows = _boxed(rows, cell)
    return disc_cell_area(rows, r, LEAST_AREA).drop("min_x", "min_y", "max_x", "max_y", "nx", "ny")


def weighted_grid(pairs: DataFrame, value: str = "coverage_percentage", by: tuple[str, ...] = ()) -> DataFrame:
    """The area-weighted mean of each touched cell. Cells meet by their id alone; what follows from it is taken from any of their pairs."""
    box = [F.first(c).alias(c) for c in ("ix", "iy", "x0", "y0", "x1", "y1")]
    mean = (F.sum(F.col(value) * F.col("area")) / F.sum("area")).alias("weighted_coverage")
    return pairs.groupBy(*by, "grid_id").agg(*box, mean)


def fill_grid(grid: DataFrame, means: DataFrame) -> DataFrame:
    """The cells of the grid that have a mean."""
    return grid.join(means.select("grid_id", "weighted_coverage"), "grid_id", "left").na.drop(subset=["weighted_coverage"])


def grid_labels(grid: DataFrame) -> DataFrame:
    """The label of each cell and where it stands."""
    return grid.withColumns({"label": F.format_string("%.2f", "weighted_coverage"), "label_x": (F.col("x0") + F.col("x1")) / 2, "label_y": (F.col("y0") + F.col("y1")) / 2})


def view_extent(grid: DataFrame, margin: float = 0.1) -> DataFrame:
    """The bounds of the cells and `margin` of their size on each side."""
    b = grid.agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    dx, dy = (F.col("c") - F.col("a")) * margin, (F.col("d") - F.col("b")) * margin
    return b.select((F.col("a") - dx).alias("min_x"), (F.col("b") - dy).alias("min_y"), (F.col("c") + dx).alias("max_x"), (F.col("d") + dy).alias("max_y"))
