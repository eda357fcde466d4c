"""The block tier: one row a raster or slice, worked on by numpy inside tasks. Twins of the operators on pixel rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .functions.color import KNEE, LINEAR, MATRIX, WHITE
from .models import Factory, Model, failure, loaded
from .operators.points import apart

#: Whole rasters are worked on by strips of so many lines, so that temporary arrays stay small.
STRIP = 256
_LINEAR = np.array(LINEAR, np.float32)


def lab(rgb: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """[..., 3] of whole numbers 0 to 255 to L, a, b, in 32 bits (kind: or 64)."""
    c = _LINEAR[rgb] if kind is np.float32 else np.array(LINEAR)[rgb]
    t = c @ (np.array(MATRIX) / np.array(WHITE)[:, None]).T.astype(kind)
    f = np.where(t > KNEE, np.cbrt(t), kind(7.787) * t + kind(16.0 / 116))
    y, fy = t[..., 1], f[..., 1]
    return np.stack((np.where(y > KNEE, 116 * fy - 16, kind(903.3) * y), 500 * (f[..., 0] - fy), 200 * (fy - f[..., 2])), -1)


def by_strips(work: Callable[[np.ndarray], np.ndarray], values: np.ndarray) -> np.ndarray:
    """work() on strips of lines, joined; the result has the lines of the input."""
    first = work(values[:STRIP])
    out = np.empty((len(values), *first.shape[1:]), first.dtype)
    out[:STRIP] = first
    for y in range(STRIP, len(values), STRIP):
        out[y : y + STRIP] = work(values[y : y + STRIP])
    return out


def off_color(values: np.ndarray, water: np.ndarray, color_threshold: float, lightness: float) -> np.ndarray:
    """Dark pixels whose a, b lie away from the water colour."""
    off = lambda v: (v[..., 0] < lightness) & (np.sqrt(((v[..., 1:] - water[1:].astype(np.float32)) ** 2).sum(-1)) > color_threshold)
    return by_strips(off, values)


def lab_distance(values: np.ndarray, water: np.ndarray) -> np.ndarray:
    return by_strips(lambda v: np.sqrt(((v - water.astype(np.float32)) ** 2).sum(-1)), values)


def lab8(values: np.ndarray) -> np.ndarray:
    scaled = values * np.array([2.55, 1, 1], values.dtype) + np.array([0, 128, 128], values.dtype)
    return np.clip(np.floor(scaled + 0.5), 0, 255).astype(np.int64)


def downsample(rgb: np.ndarray, factor: float) -> np.ndarray:
    """Area means over blocks of factor x factor pixels; the size becomes floor(size / factor). A factor of 1 or less changes nothing."""
    if factor <= 1 or not rgb.size:
        return rgb

    def along(lines: np.ndarray) -> np.ndarray:
        """lines[n, w, 3] to [n, floor(w / factor), 3]: differences of the running sum at the edges of the blocks."""
        w = lines.shape[1]
        sums = np.zeros((len(lines), w + 2, 3))
        np.cumsum(lines, 1, out=sums[:, 1:-1])
        sums[:, -1] = sums[:, -2]
        edges = np.arange(int(w / factor) + 1) * (w / int(w / factor))
        whole = np.minimum(edges.astype(int), w)
        part = (edges - whole)[None, :, None]
        at = sums[:, whole] * (1 - part) + sums[:, whole + 1] * part
        return (np.diff(at, axis=1) / (w / int(w / factor))).astype(np.float32)

    if min(int(n / factor) for n in rgb.shape[:2]) < 1:
        return rgb[:0, :0]
    narrow = by_strips(along, rgb)
    short = by_strips(along, narrow.swapaxes(0, 1)).swapaxes(0, 1)
    return np.floor(short.round(3) + np.float32(0.5)).clip(0, 255).astype(np.uint8)


def equalize(values: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of an 8-bit channel [h, w]: the rule of pixels.equalize()."""
    h, w = values.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    ny, nx = -(-h // th), -(-w // tw)
    maps = np.zeros((ny, nx, 256), np.float32)
    for ty in range(ny):
        for tx in range(nx):
            part = values[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw]
            n = np.bincount(part.ravel(), minlength=256)
            cap = max(1, int(clip * part.size / 256))
            m = np.minimum(n, cap) + np.maximum(n - cap, 0).sum() // 256
            maps[ty, tx] = np.minimum(np.floor(np.cumsum(m) * (255.0 / part.size) + 0.5), 255)

    def corner(at: np.ndarray, size: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = (at + 0.5) / size - 0.5
        low = np.floor(p).astype(int)
        return np.clip(low, 0, last), np.clip(low + 1, 0, last), p - low

    x0, x1, wx = corner(np.arange(w), tw, nx - 1)
    out = np.empty((h, w), np.uint8)
    for at in range(0, h, STRIP):
        v = values[at : at + STRIP]
        y0, y1, wy = (c[:, None] for c in corner(np.arange(at, at + len(v)), th, ny - 1))
        low = maps[y0, x0, v] * (1 - wx) + maps[y0, x1, v] * wx
        high = maps[y1, x0, v] * (1 - wx) + maps[y1, x1, v] * wx
        out[at : at + STRIP] = np.floor(low * (1 - wy) + high * wy + 0.5)
    return out


def cell_moments(values: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean L, a, b; population deviation of L) of the whole grid x grid cells of one slice."""
    h, w = values.shape[0] // grid, values.shape[1] // grid
    cells = values[: h * grid, : w * grid].reshape(h, grid, w, grid, 3)
    mean = cells.mean((1, 3), dtype=np.float64)
    squares = (cells[..., 0].astype(np.float64) ** 2).mean((1, 3))
    return mean, np.sqrt(np.maximum(0, squares - mean[..., 0] ** 2))


def merge(shape: tuple[int, int], masks: list[tuple[int, int, np.ndarray]], logic: str) -> np.ndarray:
    """(y0, x0, water) of slices to one water mask."""
    if logic == "AND" and not masks:
        return np.zeros(shape, bool)
    out = np.full(shape, logic == "AND")
    for y0, x0, m in masks:
        part = out[y0 : y0 + m.shape[0], x0 : x0 + m.shape[1]]
        part[...] = part | m if logic == "OR" else part & m
    return out


def erode(kelp: np.ndarray, kernel: int) -> np.ndarray:
    """Kelp whose whole neighbourhood inside the image is kelp, by running sums of the rest."""
    r = (kernel if kernel % 2 else kernel + 1) // 2
    out = kelp
    for axis in (0, 1):
        other = np.moveaxis(~out, axis, 0)
        sums = np.concatenate((np.zeros((1, other.shape[1]), np.int32), np.cumsum(other, 0, dtype=np.int32)))
        at = np.arange(len(other))
        out = np.moveaxis(sums[np.minimum(at + r + 1, len(other))] - sums[np.maximum(at - r, 0)] == 0, 0, axis)
    return out


def as_rgb(data: bytes, h: int, w: int) -> np.ndarray:
    """[h, w, 3] of a raster's bytes (BGR, grey, or with a fourth channel)."""
    px = np.frombuffer(data, np.uint8).reshape(h, w, -1)
    return np.repeat(px, 3, 2) if px.shape[2] == 1 else px[..., 2::-1]


def sample_colors(rasters: DataFrame, n: int = 50_000, seed: int = 0, errors: bool = False) -> DataFrame:
    """location, image, L8, A8, B8 of at most n random pixels of each raster, drawn before pixels are rows.

    errors: adds error; a raster that can't be worked on gives one row with it and no colours, in place of ending the job.
    """

    def one(location: str, image: str, h: int, w: int, data: bytes) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *str(image).encode()])
        at = rng.choice(h * w, min(n, h * w), replace=False)
        v = lab8(lab(as_rgb(data, h, w).reshape(-1, 3)[at]))
        return pd.DataFrame({"location": location, "image": str(image), "L8": v[:, 0], "A8": v[:, 1], "B8": v[:, 2]})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if not errors:
                    yield one(*row)
                    continue
                try:
                    yield one(*row).assign(error=None)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"location": [row[0]], "image": [str(row[1])], "L8": [None], "A8": [None], "B8": [None], "error": [failure(e)]})

    return rasters.where("height > 0").select("location", "image", "height", "width", "data").mapInPandas(work, "location string, image string, L8 int, A8 int, B8 int" + ", error string" * errors)


@dataclass(frozen=True)
class Prompting:
    """How slices are routed and prompted; the meaning of the names is that of plans.jobs."""

    grid: int = 64
    uniform_std: float = 4.0
    threshold_max: float = 20.0
    num_points: int = 3
    uniformity: bool = True
    strategy: str = "random"
    uniform_share: float = 0.98
    water_share: float = 0.98
    brightness: float = 100.0
    max_distance: float = 55.0
    seed: int = 0


@dataclass(frozen=True)
class Judged:
    """What is seen in a slice: its cells [cells down, cells across] (none where cells are not judged), candidates and those left one a cell as (y, x), prompt points as (x, y). all_water: the verdict without a model, null where the model decides."""

    uniform: np.ndarray
    near: np.ndarray
    shortcut: bool
    candidates: np.ndarray
    filtered: np.ndarray
    points: np.ndarray
    all_water: bool | None

    @property
    def valid(self) -> np.ndarray:
        return self.uniform & self.near


_NO_CELLS, _NO_POINTS = np.zeros((0, 0), bool), np.zeros((0, 2), np.int64)


def judge(values: np.ndarray, water: np.ndarray, size: int, how: Prompting, rng: np.random.Generator, past_shortcut: bool = False) -> Judged:
    """A slice (L, a, b with its border) by its cells, candidates and points; past_shortcut: candidates and points also of slices that are water by their cells."""
    h, w = values.shape[:2]
    g = how.grid
    uniform = near = _NO_CELLS
    shortcut = False
    if how.uniformity:
        mean, std = cell_moments(values, g)
        uniform, near = std <= how.uniform_std, np.sqrt(((mean - water) ** 2).sum(-1)) <= how.threshold_max
        shortcut = bool(uniform.size and uniform.mean() >= how.uniform_share and near.mean() >= how.water_share)
        if shortcut and not past_shortcut:
            return Judged(uniform, near, True, _NO_POINTS, _NO_POINTS, _NO_POINTS, True)
        valid = uniform & near
        found = valid[np.arange(h) * valid.shape[0] // h][:, np.arange(w) * valid.shape[1] // w] if valid.any() else np.zeros((h, w), bool)
    else:
        found = lab_distance(values, water) <= how.threshold_max
    candidates = at = np.argwhere(found)
    if how.uniformity and len(at):
        at = at[rng.permutation(len(at))]
        _, first = np.unique(at[:, 0] // g * (-(-w // g)) + at[:, 1] // g, return_index=True)
        at = at[first]
    if len(candidates) < max(1, how.num_points):
        away = lab_distance(values, water)
        all_water = shortcut or bool(values[..., 0].mean(dtype=np.float64) > how.brightness and away.mean(dtype=np.float64) < how.max_distance)
        return Judged(uniform, near, shortcut, candidates, at, _NO_POINTS, all_water)
    if how.strategy == "poisson_disk":
        chosen = apart(at.astype(float), how.num_points, size, rng)
    elif how.strategy == "center_bias":
        far = np.sqrt(((at - np.array([h / 2, w / 2])) ** 2).sum(1)) + 1e-6
        chosen = np.argsort(rng.exponential(size=len(at)) * far)[: how.num_points]
    else:
        chosen = rng.permutation(len(at))[: how.num_points]
    return Judged(uniform, near, shortcut, candidates, at, at[chosen][:, ::-1], True if shortcut else None)


def route(values: np.ndarray, water: np.ndarray, size: int, how: Prompting, rng: np.random.Generator) -> bool | np.ndarray:
    """What a slice (L, a, b with its border) is: True, all water; False, all kelp; else its prompt points (x, y) for the model."""
    seen = judge(values, water, size, how, rng)
    return seen.points if seen.all_water is None else seen.all_water


def starts(length: int, content: int, overlap: float) -> list[int]:
    """Where the slices begin along one axis; the last one moves back to the edge."""
    if content <= 0:
        raise ValueError("the padding leaves no content in a slice")
    step = content - int(overlap * content)
    n = 1 if length <= content else 1 + -(-(length - content) // step)
    return [max(0, min(k * step, length - content)) for k in range(n)]


def framed(rgb: np.ndarray, padding: int) -> np.ndarray:
    """The picture of a slice in its green border."""
    if not padding:
        return rgb
    green = np.zeros((rgb.shape[0] + 2 * padding, rgb.shape[1] + 2 * padding, 3), np.uint8)
    green[..., 1] = 255
    green[padding:-padding, padding:-padding] = rgb
    return green


def one_pass(rgb: np.ndarray, values: np.ndarray, water: np.ndarray, size: int, overlap: float, padding: int, logic: str, threshold: float, how: Prompting, model: Model | None, batch: int, key: list[int]) -> np.ndarray:
    """The water mask of one raster by slices of one size; without a model, water is what lies within the threshold of the water colour."""
    h, w = values.shape[:2]
    content = size - 2 * padding
    border = ((padding, padding), (padding, padding), (0, 0))
    done, waiting = [], []

    def predict() -> None:
        found = model(np.stack([p[2] for p in waiting]), [p[3] for p in waiting])
        for (y, x, part, _), mask in zip(waiting, found, strict=True):
            done.append((y, x, mask[padding : part.shape[0] - padding, padding : part.shape[1] - padding]))
        waiting.clear()

    for number, (y, x) in enumerate((y, x) for y in starts(h, content, overlap) for x in starts(w, content, overlap)):
        part = values[y : y + content, x : x + content]
        padded = np.pad(part, border) if padding else part
        what = route(padded, water, size, how, np.random.default_rng([how.seed, *key, size, number]))
        if isinstance(what, bool):
            done.append((y, x, np.full(part.shape[:2], what)))
        elif model is None:
            done.append((y, x, lab_distance(part, water) <= threshold))
        else:
            picture = framed(rgb[y : y + content, x : x + content], padding)
            if waiting and waiting[0][2].shape != picture.shape:
                predict()
            waiting.append((y, x, picture, what))
            if len(waiting) == batch:
                predict()
    if waiting:
        predict()
    return merge((h, w), done, logic)


def coverage(
    rasters: DataFrame, size: int = 1024, coarse_size: int = 4096, overlap: float = 0.2, threshold: float = 20.0, kernel: int = 51, color_threshold: float = 15, lightness: float = 75.0,
    padding: int = 0, clahe: bool = False, factor: float = 1.0, hierarchical: bool = True, erosion: bool = True, validation: bool = True, model_fn: Model | Factory | None = None, batch_size: int = 32, errors: bool = False, **prompting,
) -> DataFrame:
    """image, coverage_percentage of rasters with water_l, water_a, water_b: the whole job on one raster at a time, no pixel rows.

    The steps of plans.jobs.coverage(): every slice is all water, all kelp, or masked by model_fn
    with its prompt points; fine slices merge by OR, coarse ones by AND; the coarse kelp is eroded;
    disputed pixels are judged by colour. Prompt points are drawn by another generator than in
    jobs; routes are the same. clahe equalises L in 8 bits first, factor shrinks the raster before
    that. prompting: the fields of Prompting. A null image has the name "None". errors: adds error;
    a raster that fails, its data or the model on it, is a row with the message and no coverage,
    and the others go on; without it the job ends. Some 26 bytes a pixel at once: about 1.1 GB
    for 42 million; operators.tiles works on parts of rasters.
    """
    how = Prompting(**prompting)

    def one(name: str, h: int, w: int, data: bytes, water: np.ndarray) -> float:
        model = loaded(model_fn)
        rgb = downsample(as_rgb(data, h, w), factor)
        if not rgb.size:
            return 0.0
        values = by_strips(lab, rgb)
        if clahe:
            scaled = by_strips(lambda v: lab8(v).astype(np.uint8), values)
            scaled[..., 0] = equalize(scaled[..., 0])
            values = scaled * np.array([100 / 255, 1, 1], np.float32) - np.array([0, 128, 128], np.float32)
        passes = [~one_pass(rgb, values, water, s, overlap, padding, logic, threshold, how, model, batch_size, list(name.encode())) for s, logic in ((size, "OR"), (coarse_size, "AND"))[: 1 + hierarchical]]
        kelp = passes[0]
        if hierarchical:
            coarse = erode(passes[1], kernel) if erosion else passes[1]
            kelp, disputed = passes[0] & coarse, passes[0] ^ coarse
            if validation:
                kelp |= disputed & off_color(values, water, color_threshold, lightness)
        return float(np.count_nonzero(kelp) / kelp.size * 100)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, h, w, data, *water in pdf.itertuples(index=False):
                value = error = None
                try:
                    value = one(str(i), h, w, data, np.array(water))
                except Exception as e:  # noqa: BLE001
                    if not errors:
                        raise
                    error = failure(e)
                rows.append((str(i), value, error)[: 2 + errors])
            yield pd.DataFrame(rows, columns=["image", "coverage_percentage", "error"][: 2 + errors])

    given = rasters.where("height > 0").select("image", "height", "width", "data", "water_l", "water_a", "water_b")
    return given.mapInPandas(work, "image string, coverage_percentage double" + ", error string" * errors)
