"""Projection, grid and disc geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS, RADIUS, CELL, STRIPS = 6378137.0, 18.0, 30.0, 32


def west_longitude(df: DataFrame, col: str = "longitude") -> DataFrame:
    return df.withColumn(col, -F.abs(col))


def to_mercator(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """cx, cy in metres of Web Mercator; null where a coordinate is."""
    return df.withColumns({"cx": EARTH_RADIUS * F.radians(lon), "cy": EARTH_RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))})


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later steps use several times; the optimizer doesn't merge steps, so each is computed once, in generated code."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def disc_cell_area(df: DataFrame, r: float = RADIUS, least: float | None = None) -> DataFrame:
    """Adds area: that of the cell [x0, x1] x [y0, y1] inside the 64-gon around (cx, cy) with vertices on the axes. least: only rows with more than this.

    The exact area is Q(x1, y1) - Q(x0, y1) - Q(x1, y0) + Q(x0, y0), where Q(x, y) is the area of
    the polygon left of x and below y. With t the upper edge and T its integral from the left, Q is
    T(x) + sign(y) M(x, |y|); M is the integral of min(t, |y|): t itself outside of -c to c, where
    t exceeds |y|, and |y| between. T comes from sums up to each strip, c from the strip that
    holds |y|; strips are found by arithmetic, so there is no loop over them.
    """
    at = [math.pi * k / STRIPS for k in range(STRIPS + 1)]
    x, y = [-r * math.cos(t) for t in at], [r * math.sin(t) for t in at]
    sums = [0.0]
    for k in range(STRIPS):
        sums.append(sums[-1] + (x[k + 1] - x[k]) * (y[k] + y[k + 1]) / 2)
    xs, ys, slopes, areas = (F.lit(v) for v in (x, y, [(y[k + 1] - y[k]) / (x[k + 1] - x[k]) for k in range(STRIPS)], sums))
    within = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    strip = lambda angle, last: within(F.floor(angle * (STRIPS / math.pi)), 0, last).cast("int")
    c = F.col

    def integral(df: DataFrame, **of: str) -> DataFrame:
        """Adds T of columns within -r and r, by the names given."""
        df = _step(df, **{f"__k{v}": strip(F.acos(within(-c(name) / r, -1.0, 1.0)), STRIPS - 1) for v, name in of.items()})
        df = _step(df, **{f"__d{v}": c(name) - F.get(xs, c(f"__k{v}")) for v, name in of.items()})
        return _step(df, **{v: F.get(areas, c(f"__k{v}")) + c(f"__d{v}") * (F.get(ys, c(f"__k{v}")) + F.get(slopes, c(f"__k{v}")) * c(f"__d{v}") / 2) for v in of})

    columns = df.columns
    df = _step(df, __x0=within(c("x0") - c("cx"), -r, r), __x1=within(c("x1") - c("cx"), -r, r), __y0=c("y0") - c("cy"), __y1=c("y1") - c("cy"))
    df = _step(df, __a0=within(F.abs("__y0"), 0.0, r), __a1=within(F.abs("__y1"), 0.0, r))
    # the edge rises over the first half of the strips, where it passes |y| at -c
    df = _step(df, **{f"__s{j}": strip(F.asin(c(f"__a{j}") / r), STRIPS // 2 - 1) for j in "01"})
    df = _step(df, **{f"__c{j}": F.greatest(-(F.get(xs, c(f"__s{j}")) + (c(f"__a{j}") - F.get(ys, c(f"__s{j}"))) / F.get(slopes, c(f"__s{j}"))), F.lit(0.0)) for j in "01"})
    df = _step(df, **{f"__m{i}{j}": F.least(c(f"__x{i}"), -c(f"__c{j}")) for i in "01" for j in "01"})
    df = integral(df, **{f"__T{n}": f"__{n}" for n in ("x0", "x1", "c0", "c1", "m00", "m01", "m10", "m11")})

    def under(i: str, j: str) -> Column:
        xi, ci = c(f"__x{i}"), c(f"__c{j}")
        flat = c(f"__a{j}") * (F.least(F.greatest(xi, -ci), ci) + ci)
        return c(f"__Tm{i}{j}") + flat + F.when(xi > ci, c(f"__Tx{i}") - c(f"__Tc{j}")).otherwise(0.0)

    df = _step(df, **{f"__U{i}{j}": under(i, j) for i in "01" for j in "01"})
    # T(x1) - T(x0) is in both levels and goes out
    level = lambda j: F.when(c(f"__y{j}") < 0, c(f"__U0{j}") - c(f"__U1{j}")).otherwise(c(f"__U1{j}") - c(f"__U0{j}"))
    df = _step(df, __area=F.greatest(level("1") - level("0"), F.lit(0.0)))
    if least is not None:
        df = df.where(c("__area") > least)
    return df.select(*[f"`{n}`" for n in columns if n != "area"], c("__area").alias("area"))
