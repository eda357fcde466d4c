"""Images as rasters, rasters as pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rasters(spark: SparkSession, directory: str, drop_invalid: bool = True) -> DataFrame:
    """image, height, width, n_channels, data (BGR by rows), path of the images in a folder; files that can't be decoded are dropped or have height -1."""
    rows = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).load(directory)
    return rows.select(F.element_at(F.split("image.origin", "/"), -1).alias("image"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data", F.col("image.origin").alias("path"))


def pack_rasters(pixels: DataFrame, n_channels: int = 3) -> DataFrame:
    """Pixels (image, y, x, r, g, b) of whole images to rasters; an image is one group and one row. One channel: b alone."""
    kind = dict(pixels.dtypes)["image"]

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, n_channels), np.uint8)
        for k, c in enumerate("bgr"[:n_channels]):
            out[y, x, k] = table[c].to_numpy()
        return pa.table({"image": pa.array([key[0].as_py()], table["image"].type), "height": pa.array([out.shape[0]], pa.int32()), "width": pa.array([out.shape[1]], pa.int32()), "n_channels": pa.array([n_channels], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return pixels.select("image", "y", "x", "r", "g", "b").groupBy("image").applyInArrow(pack, f"image {kind}, height int, width int, n_channels int, data binary")


def explode_pixels(rasters: DataFrame) -> DataFrame:
    """image, y, x, r, g, b of each pixel; grey rasters repeat their value, a fourth channel is left out. Rows are made by whole lines, so memory is bounded by a raster."""
    kind = dict(rasters.dtypes)["image"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for image, h, w, n, data in pdf.itertuples(index=False):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                px = np.repeat(px, 3, 2) if n == 1 else px
                step = max(1, 200_000 // max(1, w))
                for y0 in range(0, h, step):
                    part = px[y0 : y0 + step]
                    y, x = np.mgrid[y0 : y0 + len(part), 0:w].astype(np.int32)
                    yield pd.DataFrame({"image": image, "y": y.ravel(), "x": x.ravel(), **{c: part[..., k].ravel().astype(np.int32) for k, c in ((2, "r"), (1, "g"), (0, "b"))}})

    rows = rasters.where("height > 0").select("image", "height", "width", "n_channels", "data")
    return rows.mapInPandas(work, f"image {kind}, y int, x int, r int, g int, b int")


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of rgb[h, w, 3] of 8 bits."""
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = rgb.reshape(h, 3 * w)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(rasters: DataFrame, directory: str) -> DataFrame:
    """Writes each raster of three channels as <image>.png, from the tasks; directory is a path that all of them reach. One row (path) a file once it runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(directory)
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for image, h, w, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                path = f"{base}/{image}.png"
                with store.open_output_stream(path) as f:
                    f.write(png(np.frombuffer(data, np.uint8).reshape(h, w, 3)[..., ::-1]))
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return rasters.where("height > 0 and n_channels = 3").select("image", "height", "width", "data").mapInArrow(work, "path string")


def write_masks(mask: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Water masks (image, y, x, is_water) as one row of bytes an image (255 for kelp, 0 for water), in Parquet; gives the path."""
    value = F.when(F.col("is_water"), 0).otherwise(255).cast("int")
    rows = mask.select("image", "y", "x", *[value.alias(c) for c in "rgb"])
    pack_rasters(rows, 1).write.mode(mode).parquet(path)
    return path


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """image, y, x, value of written masks."""
    return explode_pixels(spark.read.parquet(path)).select("image", "y", "x", F.col("r").alias("value"))
