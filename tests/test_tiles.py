"""The tiled tier against the block tier, at tile sizes below and above the kernel and the slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorecover import blocks
from shorecover.operators import masks, tiles
from shorecover.sources import rasters


def survey_like(rng):
    calm = np.array([60, 122, 128])
    out = {}
    for name, shape in (("p", (33, 45)), ("q", (20, 29)), ("r", (7, 50))):
        a = np.tile(calm, (*shape, 1)) + rng.integers(-3, 4, (*shape, 3))
        a[:, shape[1] // 2 :] = rng.integers(0, 256, (shape[0], shape[1] - shape[1] // 2, 3))
        a[shape[0] // 2 :, : shape[1] // 4] += rng.integers(-40, 60, (shape[0] - shape[0] // 2, shape[1] // 4, 3))
        out[name] = np.clip(a, 0, 255).astype(np.uint8)
    return out


@pytest.fixture(scope="module")
def pictures(spark):
    found = survey_like(np.random.default_rng(11))
    rows = [(i, *a.shape, bytearray(a[..., ::-1].tobytes()), 47.0, -14.0, -10.0) for i, a in found.items()]
    return found, spark.createDataFrame(rows, "image string, height int, width int, n_channels int, data binary, water_l double, water_a double, water_b double")


ROUTED = dict(grid=4, threshold_max=20.0, num_points=3, uniform_share=0.9, water_share=0.9, brightness=40.0, max_distance=60.0, seed=2)


@pytest.mark.parametrize("tile", [3, 8, 64])
@pytest.mark.parametrize("given", [{}, {"padding": 1, "strategy": "poisson_disk", "validation": False}, {"uniformity": False, "threshold": 25.0, "erosion": False}, {"hierarchical": False}], ids=str)
def test_coverage_equals_whole_rasters(spark, pictures, tile, given):
    options = ROUTED | {"threshold": 30.0, "kernel": 5, "color_threshold": 6.0} | given
    want = {r.image: r.coverage_percentage for r in blocks.coverage(pictures[1], 12, 24, 0.2, **options).collect()}
    got = tiles.coverage(tiles.cut_tiles(pictures[1], tile), tile, 12, 24, 0.2, **options).collect()
    assert {r.image: r.coverage_percentage for r in got} == pytest.approx(want) and not any(r.error for r in got)
    assert len(set(want.values())) > 1


def by_hand(kelp, kernel):
    r = (kernel if kernel % 2 else kernel + 1) // 2
    return np.array([[kelp[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].all() for x in range(kelp.shape[1])] for y in range(kelp.shape[0])])


@pytest.mark.parametrize("tile", [2, 7, 40])
@pytest.mark.parametrize("kernel", [1, 4, 9])
def test_erosion_with_exchanged_borders(spark, tile, kernel):
    rng = np.random.default_rng(kernel)
    water = {"a": rng.random((23, 31)) < 0.03, "b": np.zeros((5, 12), bool), "c": np.ones((3, 3), bool)}
    rows = [(i, y, x, bool(m[y, x])) for i, m in water.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    px = spark.createDataFrame(rows, "image string, y int, x int, is_water boolean")
    extent = spark.createDataFrame([(i, *m.shape) for i, m in water.items()], "image string, height int, width int")
    packed = tiles.pack_mask_tiles(px, extent, tile)
    assert {tuple(r) for r in tiles.mask_pixels(packed).collect()} == set(rows)
    got = {(r.image, r.y, r.x): r.is_water for r in tiles.mask_pixels(tiles.merge_tiles(packed, 6, kernel=kernel)).collect()}
    assert got == {(i, y, x): not bool(k[y, x]) for i, m in water.items() for k in [by_hand(~m, kernel)] for y in range(m.shape[0]) for x in range(m.shape[1])}


@pytest.mark.parametrize("logic", ["OR", "AND"])
def test_merging_overlapping_slices(spark, logic):
    rng = np.random.default_rng(4)
    h, w = 19, 26
    cut = [(box, rng.random((box[2] - box[0], box[3] - box[1])) < 0.5) for _, box in tiles.slice_windows(h, w, 9, 0.3)]
    rows = [("i", h, w, y0, x0, y1 - y0, x1 - x0, bytearray(np.packbits(m).tobytes())) for (y0, x0, y1, x1), m in cut]
    given = spark.createDataFrame(rows, f"{tiles.PLACE}, mask binary")
    want = blocks.merge((h, w), [(b[0], b[1], m) for b, m in cut], logic)
    got = {(r.y, r.x): r.is_water for r in tiles.mask_pixels(tiles.merge_tiles(given, 5, logic)).collect()}
    assert got == {(y, x): bool(want[y, x]) for y in range(h) for x in range(w)}


def test_models_see_slices_of_all_images_and_failures_stay_with_theirs(spark, pictures):
    """By a model as by whole rasters; an image on which it fails, and one without a tile, are error rows."""
    options = ROUTED | {"threshold": 30.0, "kernel": 3, "padding": 1}

    def model(rgb, points):
        return (rgb[..., 0] > 70) | np.array([len(p) > 2 for p in points])[:, None, None]

    want = {r.image: r.coverage_percentage for r in blocks.coverage(pictures[1], 12, 24, 0.2, model_fn=model, **options).collect()}
    cut_up = tiles.cut_tiles(pictures[1], 8)
    share = lambda given, fn: {r.image: (r.coverage_percentage, r.error) for r in tiles.coverage(given, 8, 12, 24, 0.2, model_fn=fn, **options).collect()}
    got = share(cut_up, model)
    assert {i: v[0] for i, v in got.items()} == pytest.approx(want) and not any(v[1] for v in got.values())

    def fails(rgb, points):
        if rgb.shape[1] == 9:
            raise RuntimeError("too flat")
        return model(rgb, points)

    got = share(cut_up, fails)
    assert got["r"] == (None, "RuntimeError: too flat") and got["p"][0] == pytest.approx(want["p"]) and got["q"][0] == pytest.approx(want["q"])
    got = share(cut_up.where("not (image = 'q' and y0 = 8 and x0 = 8)"), model)
    assert got["q"][0] is None and "don't make up" in got["q"][1] and got["p"][0] == pytest.approx(want["p"])
    assert tiles.coverage(cut_up.limit(0), 8, 12, 24, 0.2).count() == 0


def test_tasks_hold_windows(spark):
    """What meets in a group is a window of a tile, or a slice, whatever the size of the image."""
    a = np.zeros((200, 300, 3), np.uint8)
    df = spark.createDataFrame([("i", 200, 300, 3, bytearray(a.tobytes()))], "image string, height int, width int, n_channels int, data binary")
    parts = tiles.sent(tiles.cut_tiles(df, 16).withColumn("level", F.lit(0)), "data", lambda _, h, w: tiles.slice_windows(h, w, 32, 0.25), False)
    most = parts.groupBy("a").agg(F.sum(F.length("data")).alias("n")).agg(F.max("n")).first()[0]
    assert most == 32 * 32 * 3
    shares = tiles.cut_tiles(df, 16).agg(F.count("*"), F.sum(F.expr("h * w")), F.max(F.expr("h * w"))).first()
    assert tuple(shares) == (13 * 19, 200 * 300, 256)
    px = rasters.explode_pixels(df).withColumn("is_water", F.col("x") < 150)
    packed = tiles.pack_mask_tiles(px, df, 16)
    small = tiles.mask_pixels(tiles.merge_tiles(packed, 16, kernel=5)).where("not is_water").count()
    assert small == masks.erode(px.select("image", "y", "x", "is_water"), 5).where("not is_water").count() == 200 * 148
