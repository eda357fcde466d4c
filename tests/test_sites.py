"""A folder of several sites in one call: which images are chosen, what comes of them, what is kept."""

import numpy as np
import pytest

from shorecover.plans import jobs
from shorecover.sources import rasters, tables

PLAIN = dict(size=20, hierarchical=False, uniformity=False, threshold_max=1000.0, num_points=1, model_fn=lambda rgb, points: rgb[..., 0] > 100)


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(4)
    names = [f"drone_{year}_{site}_DSC0000{k}.png" for year, site in ((2021, "Bay"), (2022, "Cove"), (2023, "Reef")) for k in range(3)]
    for name in [*names, "unnamed.png"]:
        (tmp_path / name).write_bytes(rasters.png(rng.integers(60, 140, (16, 20, 3)).astype(np.uint8)))
    (tmp_path / "drone_2021_Bay_DSC00009.png").write_bytes(b"no image")
    colors = spark.createDataFrame([("drone_2021", 120, 114, 117), ("drone_2022", 120, 114, 117)], "location string, L int, A int, B int")
    known = spark.createDataFrame([(n, k, 36.9, -122.0) for k, n in enumerate(names)], "image_name string, image_id long, latitude double, longitude double")
    return str(tmp_path), names, colors, known


def chosen(spark, folder, **options):
    path, _, colors, _ = folder
    return sorted(r.image_name for r in jobs.select_images(tables.list_images(spark, path), colors, **options).collect())


def test_choice_of_sites_and_images(spark, folder):
    names = folder[1]
    assert chosen(spark, folder) == sorted([*names[:6], "drone_2021_Bay_DSC00009.png"])
    assert chosen(spark, folder, site="drone_2022") == names[3:6]
    assert chosen(spark, folder, site="drone_2023") == chosen(spark, folder, site="nowhere") == []
    assert chosen(spark, folder, images=f" {names[1]}, {names[4]},{names[1]}, none.png, {names[8]}") == [names[1], names[4]]
    assert chosen(spark, folder, site="drone_2022", images=f"{names[1]},{names[4]}") == [names[4]]
    some = chosen(spark, folder, count=2, seed=3)
    assert [n.split("_")[1] for n in some] == ["2021", "2021", "2022", "2022"] and some == chosen(spark, folder, count=2, seed=3)
    assert chosen(spark, folder, count=0) == []


def test_analyze_sites(spark, folder):
    path, names, colors, survey_rows = folder
    results, errors, sites = jobs.analyze_sites(spark, path, colors, survey_rows, **PLAIN)
    first = {r.image_name: r for r in results.collect()}
    assert sorted(first) == names[:6] and all(r.latitude == 36.9 for r in first.values())
    assert [tuple(r) for r in errors.collect()] == [("drone_2021_Bay_DSC00009.png", "not an image")]
    assert sorted(tuple(r) for r in sites.collect()) == [("drone_2021", "Bay", 4), ("drone_2022", "Cove", 3)]
    old = spark.createDataFrame([(n, k, 0.0, 0.0, -1.0) for k, n in enumerate(names[2:4])], results.schema)
    one = dict(site="drone_2022", known=old, **PLAIN)
    kept = {r.image_name: r.coverage_percentage for r in jobs.analyze_sites(spark, path, colors, survey_rows, **one)[0].collect()}
    assert kept == {names[2]: -1.0, names[3]: -1.0, **{n: first[n].coverage_percentage for n in names[4:6]}}
    again = {r.image_name: r.coverage_percentage for r in jobs.analyze_sites(spark, path, colors, survey_rows, overwrite=True, **one)[0].collect()}
    assert again == {names[2]: -1.0, **{n: first[n].coverage_percentage for n in names[3:6]}}
