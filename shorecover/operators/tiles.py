"""Rasters as rows of tiles: slices, merging, erosion with exchanged borders, and the whole job, without a task that holds a raster.

A tile row has image, height, width (of the image), y0, x0 and h, w (its own place and size). A
step that needs pixels of other tiles sends each piece to every window that it touches, cut to the
window, in one shuffle; the work on a window is local. Windows follow from arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import blocks
from ..models import Factory, Model, failure
from ..session import cut
from .segment import predict_masks, unpack_mask

PLACE = "image string, height int, width int, y0 int, x0 int, h int, w int"
_PLACE = ["image", "height", "width", "y0", "x0", "h", "w"]
_KINDS = [pa.string(), *[pa.int32()] * 6]
#: A window: its name (two numbers) and its corners y0, x0, y1, x1.
Window = tuple[tuple[int, int], tuple[int, int, int, int]]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def cut_tiles(rasters: DataFrame, tile: int = 1024) -> DataFrame:
    """Tile rows (with data, three bytes a pixel, BGR) of decoded rasters, one raster at a time; any other columns are kept. Rasters that arrive as tiles skip this."""
    others = [c for c in rasters.columns if c not in (*_PLACE, "n_channels", "data")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, h, w, data = (batch.column(c)[k].as_py() for c in range(4))
                rgb = blocks.as_rgb(data, h, w)
                kept = [batch.column(c).take(pa.array([k])) for c in range(4, batch.num_columns)]
                for y in range(0, h, tile):
                    for x in range(0, w, tile):
                        part = rgb[y : y + tile, x : x + tile]
                        rows = _table([(str(image), h, w, y, x, *part.shape[:2], part[..., ::-1].tobytes())], [*_PLACE, "data"], [*_KINDS, pa.binary()])
                        yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rows.columns], *kept], [*_PLACE, "data", *others])

    kinds = dict(rasters.dtypes)
    return rasters.where("height > 0").select("image", "height", "width", "data", *others).mapInArrow(work, ", ".join([PLACE, "data binary", *[f"{c} {kinds[c]}" for c in others]]))


def tile_windows(height: int, width: int, tile: int, reach: int = 0) -> list[Window]:
    """The tiles of an image, each grown by `reach` within it."""
    return [((y, x), (max(0, y - reach), max(0, x - reach), min(height, y + tile + reach), min(width, x + tile + reach))) for y in range(0, height, tile) for x in range(0, width, tile)]


def slice_windows(height: int, width: int, size: int, overlap: float, padding: int = 0) -> list[Window]:
    """The slices of an image without their border, named (number, 0), in the order of slicing.plan_slices()."""
    content = size - 2 * padding
    ys, xs = blocks.starts(height, content, overlap), blocks.starts(width, content, overlap)
    return [((n, 0), (y, x, min(y + content, height), min(x + content, width))) for n, (y, x) in enumerate((y, x) for y in ys for x in xs)]


def sent(rows: DataFrame, value: str, windows: Callable[[int, int, int], list[Window]], bits: bool, kept: tuple[str, ...] = ()) -> DataFrame:
    """Each piece once for each window (of its level) that it touches, cut to it: level, a, b (the window's name), the place of the cut, value, and the columns of `kept` (doubles).

    value: bits of a mask, or three bytes a pixel. windows(level, height, width).
    """
    names, types = [*_PLACE, "level", "a", "b", value, *kept], [*_KINDS, *[pa.int32()] * 3, pa.binary(), *[pa.float64()] * len(kept)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, height, width, y0, x0, h, w, data, at, *others in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                piece = unpack_mask(data, h, w) if bits else np.frombuffer(data, np.uint8).reshape(h, w, 3)
                found = []
                for (a, b), (ya, xa, yb, xb) in windows(at, height, width):
                    y, x, y1, x1 = max(y0, ya), max(x0, xa), min(y0 + h, yb), min(x0 + w, xb)
                    if y < y1 and x < x1:
                        part = piece[y - y0 : y1 - y0, x - x0 : x1 - x0]
                        found.append((image, height, width, y, x, y1 - y, x1 - x, at, a, b, (np.packbits(part) if bits else part).tobytes(), *others))
                yield from _table(found, names, types).to_batches()

    return rows.select(*_PLACE, value, "level", *kept).mapInArrow(work, ", ".join([f"{PLACE}, level int, a int, b int, {value} binary", *[f"{c} double" for c in kept]]))


def _merged(parts: list[dict], box: tuple[int, int, int, int], logic: str) -> np.ndarray:
    """One mask of a window from the pieces sent to it."""
    return blocks.merge((box[2] - box[0], box[3] - box[1]), [(p["y0"] - box[0], p["x0"] - box[1], unpack_mask(p["mask"], p["h"], p["w"])) for p in parts], logic)


def merge_tiles(masks: DataFrame, tile: int = 1024, logic: str = "OR", kernel: int | None = None) -> DataFrame:
    """Tile rows with mask (bits) from masks of slices or of other tiles, which may overlap; kernel: their kelp is eroded as well.

    Masks go to every tile within reach of the kernel, so a tile's window has the border it needs,
    whatever lies there, also where the kernel is larger than a tile; the image's own edge takes
    nothing away. One shuffle; a task holds one window.
    """
    reach = 0 if kernel is None else (kernel if kernel % 2 else kernel + 1) // 2

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        image, y, x = (k.as_py() for k in key)
        height, width = parts[0]["height"], parts[0]["width"]
        box = (max(0, y - reach), max(0, x - reach), min(height, y + tile + reach), min(width, x + tile + reach))
        water = _merged(parts, box, logic)
        if kernel is not None:
            water = ~blocks.erode(~water, kernel)
        own = water[y - box[0] :, x - box[1] :][:tile, :tile]
        return _table([(image, height, width, y, x, *own.shape, np.packbits(own).tobytes())], [*_PLACE, "mask"], [*_KINDS, pa.binary()])

    windows = lambda _, height, width: tile_windows(height, width, tile, reach)
    parts = sent(masks.withColumn("level", F.lit(0)), "mask", windows, True)
    return parts.groupBy("image", F.col("a").alias("y"), F.col("b").alias("x")).applyInArrow(work, f"{PLACE}, mask binary")


def pack_pieces(mask: DataFrame, extent: DataFrame) -> DataFrame:
    """Tile rows from pixel rows (image, y0, x0, y1, x1, y, x, is_water) of pieces by their corners, and extent (image, height, width); pixels without a row are not water."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        image, y0, x0, y1, x1 = (k.as_py() for k in key)
        own = np.zeros((y1 - y0, x1 - x0), bool)
        own[table["y"].to_numpy() - y0, table["x"].to_numpy() - x0] = table["is_water"].to_numpy()
        return _table([(image, table["height"][0].as_py(), table["width"][0].as_py(), y0, x0, *own.shape, np.packbits(own).tobytes())], [*_PLACE, "mask"], [*_KINDS, pa.binary()])

    named = lambda df, *c: df.select(F.col("image").cast("string").alias("image"), *c)
    rows = named(mask, "y0", "x0", "y1", "x1", "y", "x", "is_water").join(named(extent, "height", "width"), "image")
    return rows.groupBy("image", "y0", "x0", "y1", "x1").applyInArrow(work, f"{PLACE}, mask binary")


def pack_mask_tiles(mask: DataFrame, extent: DataFrame, tile: int = 1024) -> DataFrame:
    """Tile rows of `tile` pixels from pixel rows (image, y, x, is_water)."""
    corner = {f"{c}0": (F.floor(F.col(c) / tile) * tile).cast("int") for c in "yx"}
    rows = mask.select("image", "y", "x", "is_water").withColumns(corner).join(extent.select(F.col("image").alias("__i"), "height", "width"), F.col("image") == F.col("__i"))
    rows = rows.withColumns({"y1": F.least(F.col("y0") + tile, "height"), "x1": F.least(F.col("x0") + tile, "width")})
    return pack_pieces(rows, extent)


def mask_pixels(tiles: DataFrame) -> DataFrame:
    """image, y, x, is_water of each pixel of mask tiles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, y0, x0, h, w, mask in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w].astype(np.int32)
                columns = [pa.array([image] * (h * w), pa.string()), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(unpack_mask(mask, h, w).ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["image", "y", "x", "is_water"])

    return tiles.select("image", "y0", "x0", "h", "w", "mask").mapInArrow(work, "image string, y int, x int, is_water boolean")


_WATER = ("water_l", "water_a", "water_b")
_SLICE = ["image", "ih", "iw", "level", "y0", "x0", "h", "w", "height", "width", "data", "points", "mask", "error"]
_SLICE_KINDS = [pa.string(), *[pa.int32()] * 9, pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.string()]
_SLICE_SCHEMA = "image string, ih int, iw int, level int, y0 int, x0 int, h int, w int, height int, width int, data binary, points array<int>, mask binary, error string"


def routed(tiles: DataFrame, sizes: dict[int, int], overlap: float, padding: int, threshold: float, how: blocks.Prompting, with_model: bool) -> DataFrame:
    """A row for each slice of each level (sizes by level): its mask where the route or the colour gives it, else its picture and prompt points for a model; or an error. A task holds one slice."""

    def windows(level: int, height: int, width: int) -> list[Window]:
        return slice_windows(height, width, sizes[level], overlap, padding)

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        image, level, number = (k.as_py() for k in key)
        parts = table.to_pylist()
        height, width = parts[0]["height"], parts[0]["width"]
        y0, x0, y1, x1 = windows(level, height, width)[number][1]
        h, w = y1 - y0, x1 - x0
        given = (image, height, width, level, y0, x0, h, w)
        try:
            if sum(p["h"] * p["w"] for p in parts) != h * w:
                raise ValueError(f"the tiles of {image} don't make up the slice at {y0}, {x0}")
            rgb = np.empty((h, w, 3), np.uint8)
            for p in parts:
                rgb[p["y0"] - y0 :, p["x0"] - x0 :][: p["h"], : p["w"]] = blocks.as_rgb(p["data"], p["h"], p["w"])
            water = np.array([parts[0][c] for c in _WATER])
            values = blocks.by_strips(blocks.lab, rgb)
            border = ((padding, padding), (padding, padding), (0, 0))
            what = blocks.route(np.pad(values, border), water, sizes[level], how, np.random.default_rng([how.seed, *image.encode(), sizes[level], number]))
            if isinstance(what, bool):
                mask = np.full((h, w), what)
            elif not with_model:
                mask = blocks.lab_distance(values, water) <= threshold
            else:
                picture = blocks.framed(rgb, padding)
                row = (*picture.shape[:2], picture[..., ::-1].tobytes(), what.ravel().tolist(), None, None)
                return _table([(*given, *row)], _SLICE, _SLICE_KINDS)
            return _table([(*given, None, None, None, None, np.packbits(mask).tobytes(), None)], _SLICE, _SLICE_KINDS)
        except Exception as e:  # noqa: BLE001
            return _table([(*given, *[None] * 5, failure(e))], _SLICE, _SLICE_KINDS)

    levels = tiles.withColumn("level", F.explode(F.lit(sorted(sizes))))
    return sent(levels, "data", windows, False, _WATER).groupBy("image", "level", "a").applyInArrow(work, _SLICE_SCHEMA)


def coverage(
    tiles: DataFrame, tile: int = 1024, size: int = 1024, coarse_size: int = 4096, overlap: float = 0.2, threshold: float = 20.0, kernel: int = 51, color_threshold: float = 15, lightness: float = 75.0,
    padding: int = 0, hierarchical: bool = True, erosion: bool = True, validation: bool = True, model_fn: Model | Factory | None = None, batch_size: int = 32, **prompting,
) -> DataFrame:
    """image, coverage_percentage, error of images given as tiles of `tile` pixels with their water colour: the steps and results of blocks.coverage(), without a task that holds an image.

    Two shuffles of pixels: pieces of tiles to the slices of both passes, and bits of masks to the
    tiles within reach of the erosion, where they meet the tile's own pixels. Then counts. A model
    works on slices of all images in batches. An image with a failed slice is an error row; a
    tile that is missing is one. Equalisation and downsampling need whole images and are not offered.
    """
    sizes = {0: size, 1: coarse_size} if hierarchical else {0: size}
    reach = (kernel if kernel % 2 else kernel + 1) // 2 if erosion else 0
    slices = routed(tiles, sizes, overlap, padding, threshold, blocks.Prompting(**prompting), model_fn is not None)
    if model_fn is not None:
        slices = cut(slices)
        asked = predict_masks(slices.where("data is not null").drop("mask", "error"), model_fn, batch_size).drop("n_water")
        slices = slices.where("data is null").unionByName(asked)
    slices = cut(slices.drop("points", "data"))
    errors = slices.where("error is not null").groupBy("image").agg(F.min("error").alias("error"))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Masks of padded pictures without their border."""
        for batch in batches:
            rows = []
            for *place, level, ph, pw, mask in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ph is not None and padding:
                    mask = np.packbits(unpack_mask(mask, ph, pw)[padding:-padding, padding:-padding]).tobytes()
                rows.append((*place, level, mask))
            yield from _table(rows, [*_PLACE, "level", "mask"], [*_KINDS, pa.int32(), pa.binary()]).to_batches()

    done = slices.where("error is null").select("image", "ih", "iw", "y0", "x0", "h", "w", "level", "height", "width", "mask")
    masks = done.mapInArrow(content, f"{PLACE}, level int, mask binary")
    parts = sent(masks, "mask", lambda level, height, width: tile_windows(height, width, tile, reach if level else 0), True)

    def judge(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["image", "kelp", "pixels", "all_pixels"], [pa.string(), *[pa.int64()] * 3]
        if not left.num_rows or not right.num_rows:
            return _table([], names, kinds)
        own, pieces = left.to_pylist()[0], right.to_pylist()
        image, y, x = (k.as_py() for k in key)
        box = (y, x, y + own["h"], x + own["w"])
        kelp = ~_merged([p for p in pieces if p["level"] == 0], box, "OR")
        if hierarchical:
            wide = (max(0, y - reach), max(0, x - reach), min(own["height"], y + tile + reach), min(own["width"], x + tile + reach))
            coarse = ~_merged([p for p in pieces if p["level"] == 1], wide, "AND")
            if erosion:
                coarse = blocks.erode(coarse, kernel)
            coarse = coarse[y - wide[0] :, x - wide[1] :][: own["h"], : own["w"]]
            disputed, kelp = kelp ^ coarse, kelp & coarse
            if validation:
                water = np.array([own[c] for c in _WATER])
                kelp |= disputed & blocks.off_color(blocks.by_strips(blocks.lab, blocks.as_rgb(own["data"], own["h"], own["w"])), water, color_threshold, lightness)
        return _table([(image, int(np.count_nonzero(kelp)), kelp.size, own["height"] * own["width"])], names, kinds)

    by = ["image", F.col("y0").alias("y"), F.col("x0").alias("x")]
    counts = tiles.groupBy(*by).cogroup(parts.groupBy("image", F.col("a").alias("y"), F.col("b").alias("x"))).applyInArrow(judge, "image string, kelp long, pixels long, all_pixels long")
    total = counts.groupBy("image").agg((F.sum("kelp") / F.sum("pixels") * 100).alias("share"), (F.sum("pixels") == F.max("all_pixels")).alias("whole"))
    every = tiles.select("image").distinct().join(total, "image", "left").join(errors, "image", "left")
    error = F.coalesce("error", F.when(~F.coalesce("whole", F.lit(False)), F.lit("tiles are missing")))
    return every.select("image", F.when(error.isNull(), F.col("share")).alias("coverage_percentage"), error.alias("error"))
