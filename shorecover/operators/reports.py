"""What was seen in chosen slices of rasters: cells, candidates, points, distances. One raster a task, one row a slice."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import blocks
from ..models import failure

_POINTS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
_CELLS = pa.list_(pa.struct([("cy", pa.int32()), ("cx", pa.int32()), ("category", pa.string())]))
_COLUMNS = {
    "image": pa.string(), **{c: pa.int32() for c in ("slice_id", "x0", "y0", "x1", "y1")}, "route": pa.string(), "all_water": pa.bool_(), "uniform_pct": pa.float64(), "water_pct": pa.float64(),
    **{c: pa.int64() for c in ("n_cells", "n_green", "n_purple", "n_red", "n_candidates", "n_filtered", "n_points")}, "threshold_used": pa.float64(), "cells": _CELLS, "shown": _POINTS, "points": _POINTS,
    "distance": pa.binary(), "error": pa.string(),
}
_ROW = """image string, slice_id int, x0 int, y0 int, x1 int, y1 int, route string, all_water boolean, uniform_pct double, water_pct double,
n_cells long, n_green long, n_purple long, n_red long, n_candidates long, n_filtered long, n_points long, threshold_used double,
cells array<struct<cy: int, cx: int, category: string>>, shown array<struct<x: int, y: int>>, points array<struct<x: int, y: int>>, distance binary, error string"""


def shown_candidates(seen: blocks.Judged, grid: int, per_cell: int, rng: np.random.Generator) -> np.ndarray:
    """(y, x) of up to per_cell random candidates of each valid cell; all candidates where cells are not judged."""
    if not seen.valid.size:
        return seen.candidates
    at = seen.candidates[rng.permutation(len(seen.candidates))]
    cy, cx = at[:, 0] // grid, at[:, 1] // grid
    down, across = seen.valid.shape
    inside = (cy < down) & (cx < across)
    at, cell = at[inside], (cy * across + cx)[inside]
    at, cell = at[seen.valid.ravel()[cell]], cell[seen.valid.ravel()[cell]]
    order = np.argsort(cell, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(cell[order], cell[order])
    return at[order[place < per_cell]]


def slice_reports(
    rasters: DataFrame, slices: Collection[int] | None = None, size: int = 1024, overlap: float = 0.2, padding: int = 0, per_cell: int = 10, distances: bool = False, errors: bool = False, **prompting,
) -> DataFrame:
    """A row for each chosen slice of rasters with water_l, water_a, water_b, before any model: how blocks.coverage() sees it.

    slices: their numbers, all for None; numbers that an image does not have give no row. route:
    shortcut, fallback or model; all_water: the verdict of the first two; cells by category (green
    valid, purple uniform only, red neither); uniform_pct and water_pct null without cells;
    threshold_used null without candidates. points are prompt points, shown up to per_cell
    candidates of each valid cell, both in the slice with its border. Slices that take the shortcut
    are reported like others. distances: the distance of each pixel to the water colour, border
    included, line by line as little-endian 32-bit floats. errors: an image that fails is one row
    with the message; without it the job ends. prompting: the fields of blocks.Prompting. An empty
    table gives none; other columns are ignored.
    """
    how = blocks.Prompting(**prompting)
    wanted = None if slices is None else frozenset(slices)
    border = ((padding, padding), (padding, padding), (0, 0))
    content = size - 2 * padding

    def report(name: str, number: int, x: int, y: int, part: np.ndarray, water: np.ndarray) -> list:
        padded = np.pad(part, border) if padding else part
        key = [how.seed, *name.encode(), size, number]
        seen = blocks.judge(padded, water, size, how, np.random.default_rng(key), past_shortcut=True)
        enough = len(seen.candidates) >= max(1, how.num_points)
        category = np.where(seen.valid, "green", np.where(seen.uniform, "purple", "red"))
        xy = lambda at: [{"x": int(b), "y": int(a)} for a, b in at]
        share = lambda flags: float(flags.mean()) if flags.size else None
        return [
            name, number, x, y, x + part.shape[1], y + part.shape[0], "shortcut" if seen.shortcut else "model" if enough else "fallback", seen.all_water, share(seen.uniform), share(seen.near),
            category.size, *(int((category == c).sum()) for c in ("green", "purple", "red")), len(seen.candidates), len(seen.filtered), len(seen.points),
            float(how.threshold_max) if len(seen.candidates) else None,
            [{"cy": a, "cx": b, "category": str(c)} for (a, b), c in np.ndenumerate(category)],
            xy(shown_candidates(seen, how.grid, per_cell, np.random.default_rng([*key, 1]))), xy(seen.points[:, ::-1]),
            blocks.lab_distance(padded, water).astype("<f4").tobytes() if distances else None, None,
        ]

    def batch(row: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _COLUMNS.values(), strict=True)], list(_COLUMNS))

    def one(name: str, h: int, w: int, data: bytes, water: np.ndarray) -> Iterator[pa.RecordBatch]:
        rgb = blocks.as_rgb(data, h, w)
        corners = [(y, x) for y in blocks.starts(h, content, overlap) for x in blocks.starts(w, content, overlap)]
        for number, (y, x) in enumerate(corners):
            if wanted is None or number in wanted:
                yield batch(report(name, number, x, y, blocks.by_strips(blocks.lab, rgb[y : y + content, x : x + content]), water))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for k in range(given.num_rows):
                image, h, w, data, *water = (c[k].as_py() for c in given.columns)
                try:
                    yield from one(str(image), h, w, data, np.array(water, float))
                except Exception as e:  # noqa: BLE001
                    if not errors:
                        raise
                    yield batch([str(image), *[None] * (len(_COLUMNS) - 2), failure(e)])

    rows = rasters.where("height > 0").select("image", "height", "width", "data", "water_l", "water_a", "water_b")
    return rows.mapInArrow(work, _ROW)
