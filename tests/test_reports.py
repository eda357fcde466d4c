"""What is reported of chosen slices: the counts of the pixel tier, places by hand, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorecover import blocks
from shorecover.functions import color
from shorecover.operators import reports
from shorecover.plans import jobs
from shorecover.sources import rasters

COUNTS = ["n_cells", "n_green", "n_purple", "n_red", "n_candidates", "n_filtered", "n_points", "threshold_used"]
WATER = (47.0, -14.0, -10.0)


@pytest.fixture(scope="module")
def pictures(spark):
    """Calm water, water with noise, and a bright image of one size below a cell."""
    rng = np.random.default_rng(5)
    calm = np.array([60, 122, 128])
    found = {}
    for name, shape in (("a.png", (33, 45)), ("b.png", (20, 29)), ("c.png", (3, 30))):
        a = np.tile(calm, (*shape, 1)) + rng.integers(-3, 4, (*shape, 3))
        a[:, shape[1] // 2 :] = rng.integers(0, 256, (shape[0], shape[1] - shape[1] // 2, 3))
        found[name] = np.clip(a, 0, 255).astype(np.uint8)
    rows = [(i, *a.shape, bytearray(a[..., ::-1].tobytes()), *WATER) for i, a in found.items()]
    return found, spark.createDataFrame(rows, "image string, height int, width int, n_channels int, data binary, water_l double, water_a double, water_b double")


@pytest.mark.parametrize("given", [{}, {"padding": 2}, {"strategy": "center_bias"}, {"uniformity": False}], ids=str)
def test_counts_equal_the_pixel_tier(spark, pictures, given):
    options = dict(grid=4, uniform_std=4.0, threshold_max=12.0, num_points=3, seed=3) | given
    px = color.rgb_to_lab(rasters.explode_pixels(pictures[1])).withColumns({c: F.lit(v) for c, v in zip(("water_l", "water_a", "water_b"), WATER)})
    want = {(r.image, r.slice_id): [r[c] for c in COUNTS] for r in jobs.diagnose(px, 12, 0.2, **options).collect()}
    got = {(r.image, r.slice_id): [r[c] for c in COUNTS] for r in reports.slice_reports(pictures[1], None, 12, 0.2, **options).collect()}
    assert got == want and any(v[4] == 0 for v in want.values()) and any(v[6] > 0 for v in want.values())


def test_reports_by_hand(spark, pictures):
    how = dict(grid=4, threshold_max=12.0, num_points=2, uniform_share=0.9, water_share=0.9, seed=1)
    rows = reports.slice_reports(pictures[1], [0, 2, 99], 12, 0.2, per_cell=3, distances=True, **how).collect()
    assert sorted((r.image, r.slice_id) for r in rows) == [(i, k) for i in sorted(pictures[0]) for k in (0, 2)]
    assert {r.route for r in rows} >= {"shortcut", "fallback"}
    for r in rows:
        part = pictures[0][r.image][r.y0 : r.y1, r.x0 : r.x1]
        values = blocks.lab(part)
        far = np.sqrt(((values - np.array(WATER, np.float32)) ** 2).sum(-1))
        assert np.frombuffer(r.distance, "<f4").reshape(far.shape) == pytest.approx(far)
        green = set()
        for c in r.cells:
            v = values[c.cy * 4 : c.cy * 4 + 4, c.cx * 4 : c.cx * 4 + 4].reshape(-1, 3).astype(float)
            uniform, near = v[:, 0].std() <= 4, np.sqrt(((v.mean(0) - WATER) ** 2).sum()) <= 12
            assert c.category == ("green" if uniform and near else "purple" if uniform else "red")
            green |= {(c.cy, c.cx)} if c.category == "green" else set()
        assert len(r.cells) == r.n_cells == (part.shape[0] // 4) * (part.shape[1] // 4)
        assert r.route != "shortcut" or r.all_water
        shown = [(p.y // 4, p.x // 4) for p in r.shown]
        assert len(set(map(tuple, r.shown))) == len(shown) and set(shown) == {c for c in green if c[0] * 4 < part.shape[0]} and all(shown.count(c) == 3 for c in set(shown))
        assert len(r.points) == r.n_points and all(0 <= p.x < part.shape[1] and 0 <= p.y < part.shape[0] for p in r.points)
    again = reports.slice_reports(pictures[1].repartition(3), [2, 0], 12, 0.2, per_cell=3, distances=True, **how).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_debug_slices_goes_on_past_failures(spark, pictures):
    colors = spark.createDataFrame([("drone_2021", 120, 114, 117)], "location string, L int, A int, B int")
    bad = spark.createDataFrame([("short.png", 9, 9, 3, bytearray(b"xy")), ("none.png", -1, -1, -1, bytearray())], "image string, height int, width int, n_channels int, data binary")
    given = pictures[1].drop("water_l", "water_a", "water_b").unionByName(bad)
    seen, errors = jobs.debug_slices(given, colors, "drone_2021", [0], size=12, grid=4)
    assert sorted(r.image_name for r in seen.collect()) == sorted(pictures[0])
    found = dict(tuple(r) for r in errors.collect())
    assert found.pop("none.png") == "not an image" and "ValueError" in found.pop("short.png") and not found
    seen, errors = jobs.debug_slices(given, colors, "nowhere", [0], size=12, grid=4)
    assert not seen.count() and {tuple(r) for r in errors.where("image_name = 'a.png'").collect()} == {("a.png", "no water colour for nowhere")}
    # without a site the name tells, and these have none
    assert jobs.debug_slices(given, colors, size=12, grid=4)[1].where("error = 'no location in the name'").count() == 4
    seen, errors = jobs.debug_slices(given.limit(0), colors, "drone_2021")
    assert not seen.count() and not errors.count()
