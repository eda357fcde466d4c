"""Goldens, properties and edge rows of the operators, and the readers on real files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorecover import blocks
from shorecover.functions import color, geo, naming
from shorecover.operators import cells, heat, masks, pixels, points, slicing, survey
from shorecover.plans import jobs
from shorecover.sources import rasters, tables


def frame(spark, arrays):
    rows = [(str(i), int(y), int(x), *map(int, a[y, x])) for i, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int")


def water(df, values=(47.0, -14.0, -10.0)):
    return df.withColumns({k: F.lit(v) for k, v in zip(("water_l", "water_a", "water_b"), values, strict=True)})


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    return {"one": rng.integers(0, 256, (13, 17, 3)), "two": np.full((16, 9, 3), 90) + rng.integers(0, 8, (16, 9, 3)), "thin": rng.integers(0, 256, (5, 1, 3))}


def test_run_hash_golden(spark):
    run = dict(slice_size=1024, slice_overlap=0.2, padding=0, clahe=False, downsample_factor=1.0, num_points=3, threshold=20, threshold_max=20, final_point_strategy="poisson_disk", grid_size=64, uniformity_check=True, uniformity_std_threshold=4.0, uniform_grid_thresh=0.98, water_grid_thresh=0.98, fallback_brightness_threshold=100.0, fallback_distance_threshold=55.0)
    more = dict(hierarchical_slice_size=4096, use_erosion_merge=True, erosion_kernel_size=51, use_color_validation=True, color_validation_threshold=50, merge_color_threshold=15, merge_lightness_threshold=75.0)
    import hashlib
    import json

    for hierarchical in (True, False):
        given = run | {"hierarchical": hierarchical} | more
        hashed = {k: v for k, v in given.items() if hierarchical or k not in more}
        df = spark.createDataFrame([tuple(given.values())], list(given))
        assert naming.run_hash(df).first().run_hash == hashlib.sha256(json.dumps(hashed, sort_keys=True).encode()).hexdigest()[:8]


def test_tiers_agree(spark, images):
    px = water(color.lab_encode8(color.rgb_to_lab(frame(spark, images))))
    for r in px.collect():
        v = blocks.lab(images[r.image][r.y, r.x])
        assert np.allclose(v, (r.L, r.a, r.b_), atol=1e-3) and np.abs(blocks.lab8(v) - (r.L8, r.A8, r.B8)).max() <= 1
    sizes = pixels.image_sizes(px)
    stats = {(r.image, r.slice_id, r.cy, r.cx): (r.mean_l, r.std_l) for r in cells.cell_stats(slicing.assign_slices(px, sizes, 8), 4).collect()}
    for s in slicing.plan_slices(sizes, 8).collect():
        mean, std = blocks.cell_moments(blocks.lab(images[s.image])[s.y0 : s.y1, s.x0 : s.x1], 4)
        for cy in range(mean.shape[0]):
            for cx in range(mean.shape[1]):
                got = stats.pop((s.image, s.slice_id, cy, cx))
                assert np.allclose(got, (mean[cy, cx, 0], std[cy, cx]), atol=1e-2)
    assert not stats
    assert {tuple(r) for r in rasters.explode_pixels(rasters.pack_rasters(frame(spark, images))).collect()} == {tuple(r) for r in frame(spark, images).collect()}


def test_masks(spark, images):
    px = water(color.rgb_to_lab(frame(spark, images)))
    sizes = pixels.image_sizes(px)
    sliced = slicing.assign_slices(px, sizes, 8).select("image", "slice_id", "y", "x", (color.distance() <= 20 + F.col("slice_id") * 5).alias("is_water"))
    either, both = (masks.merge_masks(sliced, px, logic) for logic in ("OR", "AND"))
    a, b = ({(r.image, r.y, r.x) for r in m.where("is_water").collect()} for m in (either, both))
    assert b <= a
    assert not masks.merge_masks(sliced.limit(0), px, "AND").where("is_water").count()
    for kernel in (1, 3, 4):
        got = {(r.image, r.y, r.x): r.is_water for r in masks.erode(either, kernel).collect()}
        for i, rgb in images.items():
            kelp = np.array([[(i, y, x) not in a for x in range(rgb.shape[1])] for y in range(rgb.shape[0])])
            want = blocks.erode(kelp, kernel)
            k = (kernel if kernel % 2 else kernel + 1) // 2
            assert all(want[y, x] == kelp[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1].all() == (not got[i, y, x]) for y in range(want.shape[0]) for x in range(want.shape[1]))


def test_slices_cover(spark):
    df = spark.createDataFrame([("a", 64, 52), ("b", 5, 200), ("c", 32, 33)], "image string, height int, width int")
    for size, overlap in ((32, 0.2), (10, 0.5)):
        for s in slicing.plan_slices(df, size, overlap).groupBy("image").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("s")).collect():
            h, w = {"a": (64, 52), "b": (5, 200), "c": (32, 33)}[s.image]
            seen = np.zeros((h, w), int)
            for x0, y0, x1, y1 in s.s:
                assert 0 <= x0 < x1 <= w and 0 <= y0 < y1 <= h
                seen[y0:y1, x0:x1] += 1
            assert seen.min() >= 1
    with pytest.raises(ValueError):
        slicing.plan_slices(df, 4, 0.2, 2)


def test_lattice_areas_sum_to_the_polygon(spark):
    p = spark.createDataFrame([(3.3, -4.1)], "cx double, cy double")
    bounds = heat.total_bounds(p)
    total = heat.overlay(p, bounds, 7.0).agg(F.sum("area")).first()[0]
    assert abs(total - 32 * 18**2 * np.sin(2 * np.pi / 64)) < 1e-6
    assert geo.to_mercator(spark.createDataFrame([(None, 1.0)], "latitude double, longitude double")).first().cy is None


def test_poisson_points_keep_their_distance(spark):
    rng = np.random.default_rng(1)
    rows = [("i", s, int(y), int(x), 100, 100) for s in range(6) for y, x in rng.integers(0, 100, (40 if s else 2, 2))]
    df = spark.createDataFrame(rows, "image string, slice_id int, sy int, sx int, h int, w int")
    got = points.choose_points(df, "poisson_disk", 3, 5, 100)
    by = {s: [(r.y, r.x) for r in got.where(F.col("slice_id") == s).collect()] for s in range(6)}
    assert 1 <= len(by[0]) <= 2 and all(1 <= len(v) <= 3 for v in by.values())
    far = lambda v, n: all((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 > 100**2 * 2 / (n**2 * 4) for k, a in enumerate(v) for b in v[:k])
    assert far(by[0], 2) and all(far(by[s], 3) for s in range(1, 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, points.choose_points(df, "poisson_disk", 3, 5, 100).collect()))


def test_poisson_points_by_hand(spark):
    """The fold over the candidates in MD5 order, each tried once, thirty refusals in a row at most; short slices by their own distance."""
    import hashlib

    rng = np.random.default_rng(9)
    rows = [("i", s, int(y), int(x)) for s in range(40) for y, x in rng.integers(0, 60 if s % 2 else 12, (int(rng.integers(1, 90)), 2))]
    df = spark.createDataFrame(rows, "image string, slice_id int, sy int, sx int")
    for n_points, tries in ((3, 30), (6, 2), (1, 30)):
        want = []
        for s in range(40):
            mine = sorted((hashlib.md5(f"4|i|{s}|{y}|{x}".encode()).hexdigest(), y, x) for _, k, y, x in rows if k == s)
            mine = mine[: 1 + tries * (n_points - 1)]
            n, chosen, refused = min(n_points, len(mine)), [], 0
            for _, y, x in mine:
                if len(chosen) == n or refused == tries:
                    break
                if all(4 * n * n * ((y - b) ** 2 + (x - a) ** 2) > 2 * 60 * 60 for a, b in chosen):
                    chosen.append((x, y))
                    refused = 0
                else:
                    refused += 1
            want += [("i", s, x, y) for x, y in chosen]
        assert sorted(map(tuple, points.poisson_disk(df, n_points, 4, 60, tries).collect())) == sorted(want)
    assert points.poisson_disk(df, 0, 4, 60).count() == 0


def strip_area(left, right, low, high, r=18.0):
    """The area of a box inside the polygon, strip by strip, each strip's height averaged finely between its kinks."""
    at = np.pi * np.arange(33) / 32
    x, y = -r * np.cos(at), r * np.sin(at)
    total = 0.0
    for k in range(32):
        a, b = max(x[k], left), min(x[k + 1], right)
        if b <= a:
            continue
        slope = (y[k + 1] - y[k]) / (x[k + 1] - x[k])
        t = lambda v: y[k] + slope * (v - x[k])  # noqa: B023, E731
        kinks = {a, b} | {v for e in (low, high, -low, -high) if slope and a < (v := x[k] + (e - y[k]) / slope) < b}
        height = lambda v: max(0.0, min(high, t(v)) - max(low, -t(v)))  # noqa: B023, E731
        ends = sorted(kinks)
        total += sum((q - p) * (height(p) + height(q)) / 2 for p, q in zip(ends, ends[1:], strict=False))
    return total


def test_areas_by_strips(spark):
    rng = np.random.default_rng(2)
    boxes = [(float(a), float(a + w), float(b), float(b + h)) for a, b, w, h in zip(rng.uniform(-25, 20, 400), rng.uniform(-25, 20, 400), rng.uniform(0.01, 40, 400), rng.uniform(0.01, 40, 400), strict=True)]
    boxes += [(-18.0, 18.0, -18.0, 18.0), (0.0, 30.0, 0.0, 30.0), (-30.0, 0.0, -30.0, 0.0), (-40.0, -18.0, -5.0, 5.0), (0.0, 1.0, 18.0, 20.0), (18.0, 48.0, 0.0, 30.0)]
    df = spark.createDataFrame([(k, 1e7, -4e6, a + 1e7, c - 4e6, b + 1e7, d - 4e6) for k, (a, b, c, d) in enumerate(boxes)], "k int, cx double, cy double, x0 double, y0 double, x1 double, y1 double")
    small = spark.createDataFrame([(k, 0.0, 0.0, a, c, b, d) for k, (a, b, c, d) in enumerate(boxes)], df.schema)
    for given, close in ((small, 1e-9), (df, 1e-6)):
        got = {r.k: r.area for r in geo.disc_cell_area(given).collect()}
        assert all(abs(got[k] - strip_area(*b)) <= close for k, b in enumerate(boxes))
    kept = {r.k for r in geo.disc_cell_area(small, least=1e-9).collect()}
    assert kept == {k for k, b in enumerate(boxes) if strip_area(*b) > 1e-9}


def test_heatmap_plan_has_no_python(spark):
    from shorecover import catalog

    plan = catalog.heatmap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_grid_is_made_in_parallel(spark):
    """Far-apart bounds: every task makes a share of the cells, each cell once; an area without extent has none."""
    bounds = spark.createDataFrame([(0.0, 0.0, 9001.0, 18_010.0)], "min_x double, min_y double, max_x double, max_y double")
    grid = heat.make_grid(bounds, 30.0)
    nx, ny = 301, 601
    shares = grid.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(shares) > 1 and max(r["count"] for r in shares) < 0.6 * nx * ny
    total = grid.agg(F.count("*"), F.countDistinct("grid_id"), F.min("ix"), F.max("ix"), F.max("iy"), F.sum(F.col("ix") * ny + F.col("iy") - F.col("grid_id"))).first()
    assert tuple(total) == (nx * ny, nx * ny, 0, nx - 1, ny - 1, 0)
    by = spark.createDataFrame([("a", 0.0, 0.0, 60.0, 90.0), ("b", 5.0, 5.0, 35.0, 35.0), ("c", 0.0, 0.0, 0.0, 0.0)], "g string, min_x double, min_y double, max_x double, max_y double")
    assert {(r.g, r["count"]) for r in heat.make_grid(by).groupBy("g").count().collect()} == {("a", 6), ("b", 1)}


def test_poisson_rule_of_few_candidates():
    """The distance follows the number of points that can be had: two close candidates give one point, two far ones both."""
    rng = np.random.default_rng(0)
    assert len(points.apart(np.array([[0.0, 0.0], [0.0, 30.0]]), 3, 100, rng)) == 1
    assert len(points.apart(np.array([[0.0, 0.0], [0.0, 40.0]]), 3, 100, rng)) == 2
    assert points.apart(np.array([[5.0, 5.0]]), 3, 100, rng) == [0] and points.apart(np.zeros((0, 2)), 3, 100, rng) == []


def test_samples_and_slices_of_locations(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(11)], "image_id long, location string")
    for start, end in ((0, 1), (2, None), (None, -2), (-3, -1), (4, 100), (-100, 2)):
        got = {(r.location, r.image_id) for r in survey.slice_per_location(df, start, end).collect()}
        assert got == {(c, i) for c in "ab" for i in [k for k in range(11) if "ab"[k % 2] == c][start:end]}
    assert survey.sample_per_location(df, -1).count() == 11 == survey.sample_per_location(df, 50).count()
    two = survey.sample_per_location(df, 2).collect()
    assert len(two) == 4 == len({r.image_id for r in two})


def test_empty_tables(spark, images):
    px = water(color.rgb_to_lab(frame(spark, images))).limit(0)
    assert jobs.coverage(px, 8, 16, 0.2, 4, 3).count() == 0
    assert jobs.calibrate(px.withColumn("location", F.lit("x"))).count() == 0
    none = spark.createDataFrame([], "image_name string, image_id long, latitude double, longitude double, coverage_percentage double")
    assert jobs.heatmap(none).count() == 0


def test_image_files(spark, images, tmp_path):
    (tmp_path / "in/site").mkdir(parents=True)
    for name, rgb in images.items():
        (tmp_path / "in/site" / f"{name}.PNG").write_bytes(rasters.png(rgb.astype(np.uint8)))
    (tmp_path / "in/site/junk.jpg").write_bytes(b"no image")
    (tmp_path / "in/site/note.txt").write_bytes(b"x")
    folder = str(tmp_path / "in")
    assert [r.path.rsplit("/", 1)[1] for r in tables.list_images(spark, folder).collect()] == ["junk.jpg", "one.PNG", "thin.PNG", "two.PNG"]
    read = rasters.read_rasters(spark, folder)
    got = {tuple(r) for r in rasters.explode_pixels(read.withColumn("image", F.split("image", r"\.")[0])).collect()}
    assert got == {tuple(r) for r in frame(spark, images).collect()}
    found = blocks.coverage(water(read), 8, 16, 0.2, 30.0, 3, 6.0)
    assert {r.image for r in found.collect()} == {"one.PNG", "two.PNG", "thin.PNG"}
    colors = blocks.sample_colors(read.withColumn("location", F.lit("site")), 50)
    assert colors.groupBy("image").count().agg(F.max("count")).first()[0] == 50
    assert pixels.site_colors(colors).first().location == "site"


ROUTED = dict(grid=4, uniform_std=9.0, threshold_max=14.0, num_points=3, brightness=40.0, max_distance=40.0, uniform_share=0.7, water_share=0.7)


def survey_like(rng):
    """Rasters with calm, dark and mixed parts, so that slices take all three routes."""
    calm = np.array([60, 122, 128])
    out = {}
    for name, shape in (("p", (33, 45)), ("q", (20, 29)), ("r", (7, 50))):
        a = np.tile(calm, (*shape, 1)) + rng.integers(-3, 4, (*shape, 3))
        a[:, shape[1] // 2 :] = rng.integers(0, 256, (shape[0], shape[1] - shape[1] // 2, 3))
        a[shape[0] // 2 :, : shape[1] // 4] += rng.integers(-40, 60, (shape[0] - shape[0] // 2, shape[1] // 4, 3))
        out[name] = np.clip(a, 0, 255)
    return out


@pytest.mark.parametrize("given", [{}, {"padding": 1, "strategy": "poisson_disk", "validation": False}, {"uniformity": False, "threshold": 25.0, "erosion": False}], ids=str)
def test_block_coverage_equals_pixel_rows(spark, given):
    """The whole job, routes included, gives the same share in both tiers."""
    rows = frame(spark, survey_like(np.random.default_rng(11)))
    px = water(color.rgb_to_lab(rows))
    options = ROUTED | {"threshold": 30.0} | given
    want = {r.image: r.coverage_percentage for r in jobs.coverage(px, 12, 24, 0.2, kernel=3, color_threshold=6.0, **options).collect()}
    got = {r.image: r.coverage_percentage for r in blocks.coverage(water(rasters.pack_rasters(rows)), 12, 24, 0.2, kernel=3, color_threshold=6.0, **options).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert len(set(want.values())) > 1


def test_all_routes_are_taken():
    how, found = blocks.Prompting(**ROUTED), set()
    for a in survey_like(np.random.default_rng(11)).values():
        values = blocks.lab(a)
        for y in range(0, a.shape[0], 10):
            for x in range(0, a.shape[1], 10):
                what = blocks.route(values[y : y + 12, x : x + 12], np.array([47.0, -14.0, -10.0]), 12, how, np.random.default_rng(0))
                found.add(what if isinstance(what, bool) else "model")
    assert found == {True, False, "model"}


def test_the_coarse_kelp_is_eroded(spark):
    """One fine kelp pixel in a coarse mask of kelp stays; one coarse kelp pixel in fine kelp goes."""
    every = np.ones((8, 8), bool)
    one = np.zeros((8, 8), bool)
    one[4, 4] = True
    rows = lambda kelp: spark.createDataFrame([("i", y, x, not bool(kelp[y, x])) for y in range(8) for x in range(8)], "image string, y int, x int, is_water boolean")
    share = lambda fine, coarse: masks.coverage(masks.merge_passes(rows(fine), masks.erode(rows(coarse), 3))).first().coverage_percentage
    assert share(one, every) == 100 / 64 and share(every, one) == 0
    report = masks.merge_report(masks.merge_passes(rows(one), masks.erode(rows(every), 3)), rows(one), rows(every), masks.erode(rows(every), 3)).first()
    assert (report.n_before, report.n_after, report.n_kelp) == (64, 64, 1)
    # the jobs: fine slices are all kelp but one, the coarse slice is kelp in one pixel
    dark, sea = [20, 20, 20], [60, 122, 128]
    a = np.tile(dark, (16, 16, 1))
    a[:8, :8] = sea
    px = water(color.rgb_to_lab(frame(spark, {"i": a})))
    plain = dict(grid=4, threshold=20.0, threshold_max=1e-9, brightness=1000.0, color_threshold=1000.0, num_points=1, uniformity=False)
    got = [f.first().coverage_percentage for f in (jobs.coverage(px, 8, 16, 0.0, kernel=3, **plain), blocks.coverage(water(rasters.pack_rasters(frame(spark, {"i": a}))), 8, 16, 0.0, kernel=3, **plain))]
    assert got == [100.0, 100.0]


def test_the_model_gets_slices_and_points(spark):
    """A model of one's own sees 8-bit pictures of one shape with its prompt points inside them, in batches."""
    images = survey_like(np.random.default_rng(5))

    def model(rgb, prompts):
        assert rgb.dtype == np.uint8 and rgb.ndim == 4 and len(rgb) == len(prompts) <= 2
        out = np.zeros(rgb.shape[:3], bool)
        for k, p in enumerate(prompts):
            assert 1 <= len(p) <= 3 and (p >= 0).all() and (p[:, 0] < rgb.shape[2]).all() and (p[:, 1] < rgb.shape[1]).all()
            out[k, : rgb.shape[1] // 2] = True
        return out

    read = water(rasters.pack_rasters(frame(spark, images)))
    half = {r.image: r.coverage_percentage for r in blocks.coverage(read, 12, 24, 0.2, model_fn=model, batch_size=2, padding=1, **ROUTED).collect()}
    plain = {r.image: r.coverage_percentage for r in blocks.coverage(read, 12, 24, 0.2, padding=1, **ROUTED).collect()}
    assert set(half) == set(plain) and half != plain


def test_equalize_and_downsample_by_blocks(spark, images):
    a = survey_like(np.random.default_rng(3))
    px = color.lab_encode8(color.rgb_to_lab(frame(spark, a)))
    got = {(r.image, r.y, r.x): (r.v, r.equalized) for r in pixels.equalize(px, "L8").collect()}
    for i, rgb in a.items():
        v = np.array([[got[i, y, x][0] for x in range(rgb.shape[1])] for y in range(rgb.shape[0])])
        want = np.array([[got[i, y, x][1] for x in range(rgb.shape[1])] for y in range(rgb.shape[0])])
        assert (np.abs(blocks.equalize(v).astype(int) - want) <= 1).all() and (blocks.equalize(v) == want).mean() > 0.99
    for factor in (1.5, 2.0, 3.3):
        small = {(r.image, r.y, r.x): (r.r, r.g, r.b) for r in pixels.downsample(frame(spark, a), factor).collect()}
        for i, rgb in a.items():
            out = blocks.downsample(rgb, factor).astype(int)
            assert out.shape[:2] == tuple(int(n / factor) for n in rgb.shape[:2])
            assert all(np.abs(out[y, x] - small[i, y, x]).max() <= 1 for y in range(out.shape[0]) for x in range(out.shape[1]))
    read = water(rasters.pack_rasters(frame(spark, a)))
    assert blocks.coverage(read, 12, 24, 0.2, clahe=True, factor=1.5, **ROUTED).count() == 3


def test_analyze_from_files(spark, tmp_path):
    """From a folder to results and error rows; a second run keeps what is done."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rgb in enumerate(survey_like(np.random.default_rng(2)).values()):
        (folder / f"drone_2022_Cove_DSC0000{k}.png").write_bytes(rasters.png(rgb.astype(np.uint8)))
    (folder / "drone_2022_Cove_DSC00009.png").write_bytes(b"no image")
    (folder / "stray.png").write_bytes(rasters.png(np.zeros((4, 4, 3), np.uint8)))
    (folder / "other_2021_Bay_DSC00001.png").write_bytes(rasters.png(np.zeros((4, 4, 3), np.uint8)))
    read = rasters.read_rasters(spark, str(folder), drop_invalid=False)
    colors = pixels.site_colors(blocks.sample_colors(naming.drop_unlocated(naming.with_location(read, "image")), 100)).where("location = 'drone_2022'")
    known = spark.createDataFrame([("drone_2022_Cove_DSC00000.png", 7, 36.9, -122.0)], "image_name string, image_id long, latitude double, longitude double")
    results, errors = jobs.analyze(read, colors, known, size=12, coarse_size=24, kernel=3, **ROUTED)
    rows = {r.image_name: r for r in results.collect()}
    assert sorted(rows) == [f"drone_2022_Cove_DSC0000{k}.png" for k in range(3)] and rows["drone_2022_Cove_DSC00000.png"].image_id == 7
    assert {r.image_name: r.error for r in errors.collect()} == {"drone_2022_Cove_DSC00009.png": "not an image", "stray.png": "no location in the name", "other_2021_Bay_DSC00001.png": "no water colour for other_2021"}
    old = spark.createDataFrame([("drone_2022_Cove_DSC00000.png", 7, 36.9, -122.0, 1.25)], results.schema)
    again, _ = jobs.analyze(read, colors, known, old, size=12, coarse_size=24, kernel=3, **ROUTED)
    again = {r.image_name: r.coverage_percentage for r in again.collect()}
    assert again.pop("drone_2022_Cove_DSC00000.png") == 1.25 and again == {k: r.coverage_percentage for k, r in rows.items() if k in again}


def test_documents_keep_the_first_run(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", 1, 1.0, 2.0, 3.0)], "image_name string, image_id long, latitude double, longitude double, coverage_percentage double")
    first = tables.documents(rows, "analyze", {"n": "1"})
    again = tables.documents(rows, "other", {"n": "2"}, existing=first).first()
    assert (again.command, again.run_args) == ("analyze", {"n": "1"})
    assert tables.read_site_colors(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "bad.json").write_text("{no json")
    assert tables.read_results(spark, str(tmp_path / "bad.json")).count() == 0
