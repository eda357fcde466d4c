"""Routes of slices and masks by a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import blocks
from ..models import Factory, Model, failure, loaded
from .cells import SLICE


def route_slices(slices: DataFrame, shortcuts: DataFrame, points: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """slices and route: "shortcut" (all water), "fallback" (no points; all_water tells) or "model"."""
    rows = slices.join(shortcuts.select(*SLICE, "shortcut"), SLICE, "left").join(points.groupBy(*SLICE).agg(F.count("*").alias("n_points")), SLICE, "left")
    rows = rows.join(fallbacks.select(*SLICE, "all_water"), SLICE, "left").na.fill({"n_points": 0})
    route = F.when(F.coalesce("shortcut", F.lit(False)), "shortcut").when(F.col("n_points") == 0, "fallback").otherwise("model")
    return rows.withColumns({"route": route, "all_water": F.coalesce("all_water", F.lit(False))}).drop("shortcut")


def color_mask(water: tuple[float, float, float], threshold: float = 20.0) -> Factory:
    """The model that ships: water is what lies within the threshold of the water colour (L, a, b), in double precision; it needs no points."""

    def make() -> Model:
        def model(rgb: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
            return np.sqrt(((blocks.lab(rgb, np.float64) - np.array(water)) ** 2).sum(-1)) <= threshold

        return model

    return Factory(make)


#: So many shapes of slices wait for their batch at once.
SHAPES = 8
_ADDED = (("mask", pa.binary()), ("n_water", pa.int64()), ("error", pa.string()))


def predict_masks(slices: DataFrame, model: Model | Factory, batch_size: int = 32) -> DataFrame:
    """slices: height, width, data (the bytes of a raster), perhaps points (array of x, y, x, y ...), and any others; adds mask (bits by rows, see unpack_mask), n_water and error.

    The model is loaded once a worker and sees up to batch_size slices of one shape, of whatever
    images; slices without points get an empty list of them. A slice whose data or on which the model
    fails has the message as error and no mask; of a batch that fails each slice is tried by itself.
    Columns of these names are replaced. A task holds SHAPES batches at most.
    """
    slices = slices.drop(*[n for n, _ in _ADDED])

    def predict(rows: list[pa.RecordBatch], model_fn: Model) -> Iterator[pa.RecordBatch]:
        given = [r.select([c for c in ("height", "width", "data", "points") if c in r.schema.names]).to_pylist()[0] for r in rows]
        found: list[tuple] = []
        try:
            rgb = np.stack([blocks.as_rgb(g["data"], g["height"], g["width"]) for g in given])
            masks = np.asarray(model_fn(rgb, [np.array(g.get("points") or [], np.int64).reshape(-1, 2) for g in given]), bool)
            if masks.shape != rgb.shape[:3]:
                raise ValueError(f"the model gave masks of {masks.shape} for slices of {rgb.shape[:3]}")
            found = [(np.packbits(m).tobytes(), int(m.sum()), None) for m in masks]
        except Exception as e:  # noqa: BLE001
            if len(rows) > 1:
                for r in rows:
                    yield from predict([r], model_fn)
                return
            found = [(None, None, failure(e))]
        for r, values in zip(rows, found, strict=True):
            added = [pa.array([v], kind) for v, (_, kind) in zip(values, _ADDED, strict=True)]
            yield pa.RecordBatch.from_arrays([*r.columns, *added], [*r.schema.names, *[n for n, _ in _ADDED]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_fn = loaded(model)
        waiting: dict[tuple, list[pa.RecordBatch]] = {}
        for batch in batches:
            shapes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)
            for k, shape in enumerate(shapes):
                waiting.setdefault(shape, []).append(batch.take(pa.array([k])))
                if len(waiting[shape]) == batch_size or len(waiting) > SHAPES:
                    full = shape if len(waiting[shape]) == batch_size else next(iter(waiting))
                    yield from predict(waiting.pop(full), model_fn)
        for rows in waiting.values():
            yield from predict(rows, model_fn)

    kinds = [T.StructField("mask", T.BinaryType()), T.StructField("n_water", T.LongType()), T.StructField("error", T.StringType())]
    return slices.mapInArrow(work, T.StructType([*slices.schema, *kinds]))


def unpack_mask(mask: bytes, height: int, width: int) -> np.ndarray:
    """water[height, width] of a mask."""
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=height * width).reshape(height, width).astype(bool)


def combine_routes(*routes: DataFrame) -> DataFrame:
    """The masks of all routes as one relation."""
    out = routes[0]
    for other in routes[1:]:
        out = out.unionByName(other)
    return out
