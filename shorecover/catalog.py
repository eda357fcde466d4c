"""The registered queries of the coverage library: each applies one operator to relations that
Spark derives from the given tables (see fixtures). Doubles are rounded to 6 places here only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import fixtures as fx
from .catalog_sql import SQL
from .functions import color, geo, naming
from .operators import cells, heat, masks, pixels, points, reports, segment, slicing, survey, tiles
from .plans import jobs
from .session import cut, temporary
from .sources import rasters as raster_source
from .sources import tables
from .sources.store import ResultStore
from .streaming.watch import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    _QUERIES[f.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _located(spark, d):
    return naming.drop_unlocated(naming.with_location(fx.survey(spark, d)))


def _results(spark, d):
    return fx.survey(spark, d).where("image_id % 3 = 0")


def _colors(spark, d):
    """Colours of the locations whose id sum is even: some locations have none."""
    return _located(spark, d).groupBy("location").agg(F.sum("image_id").alias("s")).where("s % 2 = 0").select("location", *[(F.col("s") % n + 60).cast("int").alias(c) for c, n in (("L", 60), ("A", 50), ("B", 70))])


def _points(spark, d):
    return geo.to_mercator(geo.west_longitude(fx.survey(spark, d))).where("cx is not null and cy is not null")


@_query
def heatmap(spark, d):
    return jobs.heatmap(fx.survey(spark, d)).select("ix", "iy", "grid_id", "weighted_coverage")


@_query
def calibration(spark, d):
    return jobs.calibrate(fx.samples(spark, d))


@_query
def coverage_job(spark, d):
    return jobs.coverage(fx.lab(spark, d), fx.SLICE, 64, fx.OVERLAP, fx.CELL, fx.KERNEL, uniform_std=4.0, threshold_max=10.0, num_points=3, seed=fx.SEED)


@_query
def coverage_options(spark, d):
    """The job with its options: padded slices, cells not judged, no erosion and no colour check."""
    return jobs.coverage(fx.lab(spark, d), fx.SLICE, 64, fx.OVERLAP, fx.CELL, erosion=False, validation=False, threshold=14, threshold_max=9.0, num_points=60, padding=2, uniformity=False, brightness=38.0, max_distance=22.0)


@_query
def prj_1_location(spark, d):
    return naming.with_location(fx.survey(spark, d)).select("image_id", "location")


@_query
def prj_2_drop_unlocated(spark, d):
    return _located(spark, d).select("image_id", "location")


@_query
def prj_3_site_name(spark, d):
    return naming.site_name(_located(spark, d))


@_query
def prj_4_title_token(spark, d):
    return naming.title_token(_located(spark, d))


@_query
def prj_5_num_id(spark, d):
    return naming.with_num_id(fx.survey(spark, d)).select("image_id", "num_id")


@_query
def prj_6_basename(spark, d):
    return naming.with_basename(fx.survey(spark, d).select("image_id", F.concat(F.lit("images/a.b/"), "image_name").alias("path"))).select("image_id", "basename", "stem")


@_query
def prj_7_west_longitude(spark, d):
    return geo.west_longitude(fx.survey(spark, d)).select("image_id", "longitude")


@_query
def prj_8_pick_images(spark, d):
    rows = fx.survey(spark, d)
    names = rows.where("image_id % 97 = 0").groupBy((F.col("image_id") % 13).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "image_name"))), lambda s: s["image_name"]), " ,  ").alias("list"))
    return survey.pick_images(rows, names.select(F.concat(F.lit("none.JPG, "), "list").alias("list"))).select("pos", "image_name", "image_id")


@_query
def prj_9_pick_sites(spark, d):
    return survey.pick_sites(_located(spark, d), _colors(spark, d)).select("image_id", "location")


@_query
def prj_10_run_hash(spark, d):
    runs = spark.read.parquet(f"{d}/supplier.parquet").selectExpr(
        "s_suppkey", "int(512 * (1 + s_suppkey % 4)) as slice_size", "0.2D as slice_overlap", "int(0) as padding", "s_suppkey % 2 = 0 as clahe", "1.0D as downsample_factor", "int(s_suppkey % 7) as num_points", "int(20) as threshold", "int(s_suppkey % 30) as threshold_max",
        "case when s_suppkey % 3 = 0 then 'center_bias' else 'poisson_disk' end as final_point_strategy", "int(64) as grid_size", "true as uniformity_check", "4.0D as uniformity_std_threshold", "0.98D as uniform_grid_thresh", "0.98D as water_grid_thresh", "100.0D as fallback_brightness_threshold",
        "55.0D as fallback_distance_threshold", "s_suppkey % 5 <> 0 as hierarchical", "int(4096) as hierarchical_slice_size", "true as use_erosion_merge", "int(51) as erosion_kernel_size", "true as use_color_validation", "int(50) as color_validation_threshold", "int(15) as merge_color_threshold", "75.0D as merge_lightness_threshold",
    )
    return naming.run_hash(runs).select("s_suppkey", "run_hash")


@_query
def prj_11_result_rows(spark, d):
    return survey.result_rows(fx.survey(spark, d).withColumns({"image_id": F.col("image_id").cast("string"), "coverage_percentage": F.col("coverage_percentage").cast("string")}))


@_query
def prj_12_cell_category(spark, d):
    return cells.with_cell_category(fx.flagged(spark, d)).select("image", "slice_id", "cy", "cx", "category")


@_query
def prj_13_distance_map(spark, d):
    return color.distance_map(fx.lab(spark, d), 4).select("image", "y", "x", "dist")


@_query
def prj_14_grid_labels(spark, d):
    return heat.grid_labels(jobs.heatmap(fx.survey(spark, d))).select("ix", "iy", "label", "label_x", "label_y")


@_query
def join_1_metadata(spark, d):
    rows = fx.survey(spark, d)
    twice = rows.unionAll(rows.where("image_id % 10 = 1").withColumn("image_id", F.col("image_id") + 1_000_000))
    results = rows.select(F.when(F.col("image_id") % 11 == 0, F.concat("image_name", F.lit("x"))).otherwise(F.col("image_name")).alias("image_name"), "coverage_percentage")
    return survey.attach_metadata(results, twice.drop("coverage_percentage")).select("image_name", "coverage_percentage", "image_id", "latitude", "longitude")


@_query
def join_2_pending_images(spark, d):
    rows = _located(spark, d)
    return survey.pending_images(rows, rows.where("image_id % 3 = 0")).select("image_id", "location")


@_query
def join_3_pending_results(spark, d):
    return survey.pending_results(fx.survey(spark, d), _results(spark, d)).select("image_id", "image_name")


@_query
def join_4_upsert(spark, d):
    rows = fx.survey(spark, d)
    return survey.upsert_results(_results(spark, d), rows.where("image_id % 4 = 0").withColumn("coverage_percentage", F.lit(1.5))).select("image_id", "image_name", "coverage_percentage")


@_query
def join_5_water(spark, d):
    return survey.with_water(_located(spark, d), _colors(spark, d)).select("image_id", "water_l", "water_a", "water_b")


@_query
def join_6_assign_slices(spark, d):
    return fx.sliced(spark, d).select("image", "slice_id", "y", "x")


@_query
def join_7_candidates(spark, d):
    return fx.candidates(spark, d).select("image", "slice_id", "sy", "sx", "cy", "cx")


@_query
def join_8_compare(spark, d):
    return masks.compare_masks(fx.fine(spark, d), fx.coarse(spark, d))


@_query
def join_9_overlay(spark, d):
    """Positions to the centimetre: the engines' tangents differ in the last bit, which areas near 1e7 m would show."""
    p = _points(spark, d).withColumns({"cx": F.round("cx", 2), "cy": F.round("cy", 2)})
    return heat.overlay(p, heat.total_bounds(p)).select("image_id", "ix", "iy", "grid_id", "area")


@_query
def join_10_fill_grid(spark, d):
    p = _points(spark, d)
    bounds = heat.total_bounds(p)
    return heat.fill_grid(heat.make_grid(bounds), heat.weighted_grid(heat.overlay(p, bounds))).select("grid_id", "ix", "iy", "weighted_coverage")


@_query
def agg_1_site_colors(spark, d):
    return pixels.site_colors(color.lab_encode8(color.rgb_to_lab(fx.samples(spark, d))))


@_query
def agg_2_histogram(spark, d):
    return pixels.channel_histogram(fx.samples(spark, d), 32, "location", ("r", "g", "b"))


@_query
def agg_3_cell_stats(spark, d):
    return cells.cell_stats(fx.sliced(spark, d), fx.CELL).select("image", "slice_id", "cy", "cx", "n", "mean_l", "mean_a", "mean_b", "std_l")


@_query
def agg_4_cell_flags(spark, d):
    return fx.flagged(spark, d).select("image", "slice_id", "cy", "cx", "is_uniform", "is_water", "is_valid")


@_query
def agg_5_shortcut(spark, d):
    return cells.slice_shortcut(fx.flagged(spark, d))


@_query
def agg_6_fallback(spark, d):
    return cells.slice_fallback(fx.sliced(spark, d), 46.0, 12.0)


@_query
def agg_6_fallback_padded(spark, d):
    px = fx.lab(spark, d)
    rows = slicing.assign_slices(px, pixels.image_sizes(px), fx.SLICE, fx.OVERLAP, 2)
    return cells.slice_fallback(slicing.with_border(rows, 2), 38.0, 22.0)


@_query
def agg_7_or_merge(spark, d):
    return fx.fine(spark, d)


@_query
def agg_8_and_merge(spark, d):
    given = fx.slice_masks(spark, d).where("image % 5 <> 2 and slice_id <> 1")
    return masks.merge_masks(given, fx.rasters(spark, d), "AND")


@_query
def agg_9_coverage(spark, d):
    return masks.coverage(fx.fine(spark, d))


@_query
def agg_10_weighted_grid(spark, d):
    p = _points(spark, d)
    return heat.weighted_grid(heat.overlay(p, heat.total_bounds(p))).select("grid_id", "ix", "iy", "weighted_coverage")


@_query
def agg_11_bounds(spark, d):
    p = naming.with_location(_points(spark, d))
    return heat.total_bounds(p, by=("location",))


@_query
def agg_11_view_extent(spark, d):
    return heat.view_extent(jobs.heatmap(fx.survey(spark, d)))


@_query
def agg_12_diagnostics(spark, d):
    return jobs.diagnose(fx.lab(spark, d), fx.SLICE, fx.OVERLAP, fx.CELL, 4.0, 10.0, 3, fx.SEED)


@_query
def agg_13_merge_report(spark, d):
    fine, coarse = fx.fine(spark, d), fx.coarse(spark, d)
    eroded = masks.erode(coarse, fx.KERNEL)
    return masks.merge_report(masks.merge_passes(fine, eroded, fx.lab(spark, d), 6, 75.0), fine, coarse, eroded)


@_query
def win_1_slice_per_location(spark, d):
    return survey.slice_per_location(_located(spark, d), 2, -3).select("image_id", "location")


@_query
def win_2_sample_per_location(spark, d):
    return survey.sample_per_location(_located(spark, d), 20, fx.SEED).select("image_id", "location")


@_query
def win_3_sample_images(spark, d):
    return survey.sample_images(naming.with_site_name(_located(spark, d)), 15, fx.SEED).select("image_name", "site_name")


@_query
def win_4_one_per_cell(spark, d):
    return fx.filtered(spark, d).select("image", "slice_id", "cell_id", "sy", "sx")


@_query
def win_5_sample_pixels(spark, d):
    return pixels.sample_pixels(fx.rasters(spark, d), 500, fx.SEED)


@_query
def win_6_random_points(spark, d):
    return points.choose_points(fx.filtered(spark, d), "random", 3, fx.SEED)


@_query
def win_7_center_bias(spark, d):
    return points.choose_points(fx.filtered(spark, d), "center_bias", 3, fx.SEED)


@_query
def win_8_poisson_disk(spark, d):
    return points.choose_points(fx.filtered(spark, d), "poisson_disk", 3, fx.SEED, fx.SLICE)


@_query
def win_9_require_points(spark, d):
    return points.require_points(fx.filtered(spark, d), fx.candidates(spark, d), 200).select("image", "slice_id", "sy", "sx")


@_query
def win_10_erode(spark, d):
    return masks.erode(fx.fine(spark, d), fx.KERNEL)


def _pixels(tile_rows):
    return tiles.mask_pixels(tile_rows).withColumn("image", F.col("image").cast("int"))


@_query
def win_10_erode_tiles(spark, d):
    """The erosion on tiles smaller than its reach, borders exchanged."""
    fine = fx.fine(spark, d)
    return _pixels(tiles.merge_tiles(tiles.pack_mask_tiles(fine, pixels.image_sizes(fine), 5), 7, kernel=fx.KERNEL))


def _slice_pieces(spark, d, only="true"):
    masked = fx.slice_masks(spark, d).where(only)
    rows = masked.join(fx.sliced(spark, d).select("image", "slice_id", "y", "x", "y0", "x0", "y1", "x1"), ["image", "slice_id", "y", "x"])
    return tiles.pack_pieces(rows, pixels.image_sizes(fx.rasters(spark, d)))


@_query
def agg_7_merge_tiles(spark, d):
    """Masks of overlapping slices merged by OR into tiles."""
    return _pixels(tiles.merge_tiles(_slice_pieces(spark, d), 20))


@_query
def coverage_tiles(spark, d):
    """The coverage job on tiles of 24 pixels: no task holds an image."""
    rows = tiles.cut_tiles(raster_source.pack_rasters(fx.rasters(spark, d)), 24).withColumns({c: F.lit(v) for c, v in fx.WATER.items()})
    found = tiles.coverage(rows, 24, fx.SLICE, 64, fx.OVERLAP, kernel=fx.KERNEL, grid=fx.CELL, uniform_std=4.0, threshold_max=10.0, num_points=3, seed=fx.SEED)
    return found.select(F.col("image").cast("int").alias("image"), "coverage_percentage")


@_query
def debug_slices(spark, d):
    """What the block tier sees in each slice of whole rasters, with its route."""
    rows = raster_source.pack_rasters(fx.rasters(spark, d)).withColumns({c: F.lit(v) for c, v in fx.WATER.items()})
    seen = reports.slice_reports(rows, None, fx.SLICE, fx.OVERLAP, grid=fx.CELL, uniform_std=4.0, threshold_max=10.0, num_points=3, seed=fx.SEED, brightness=46.0, max_distance=12.0)
    kept = ["slice_id", "x0", "y0", "x1", "y1", "route", "all_water", "n_cells", "n_green", "n_purple", "n_red", "n_candidates", "n_filtered", "n_points", "threshold_used"]
    return seen.select(F.col("image").cast("int").alias("image"), *kept, F.round("uniform_pct", 6).alias("uniform_pct"), F.round("water_pct", 6).alias("water_pct"), F.size("shown").alias("n_shown"))


@_query
def win_11_sample_per_cell(spark, d):
    return points.sample_per_cell(fx.candidates(spark, d), fx.flagged(spark, d), 10, fx.SEED).select("image", "slice_id", "sy", "sx")


@_query
def win_12_equalize(spark, d):
    return pixels.equalize(color.lab_encode8(color.rgb_to_lab(fx.rasters(spark, d))), "L8").select("image", "y", "x", "v", "equalized")


@_query
def math_1_lab(spark, d):
    return fx.lab(spark, d).select("image", "y", "x", F.col("L").alias("lab_l"), F.col("a").alias("lab_a"), F.col("b_").alias("lab_b"))


@_query
def math_2_lab8(spark, d):
    return color.lab_encode8(fx.lab(spark, d)).select("image", "y", "x", "L8", "A8", "B8")


@_query
def math_3_decode(spark, d):
    return color.lab_decode8(_colors(spark, d)).select("location", "water_l", "water_a", "water_b")


@_query
def math_4_water_pixels(spark, d):
    return color.water_pixels(fx.lab(spark, d), 8).select("image", "y", "x", "dist")


@_query
def math_5_validate(spark, d):
    return color.validate_color(fx.lab(spark, d), 6, 75.0).select("image", "y", "x", "validated")


@_query
def math_6_merge_passes(spark, d):
    return masks.merge_passes(fx.fine(spark, d), fx.coarse(spark, d), fx.lab(spark, d), 6, 75.0)


@_query
def math_7_downsample(spark, d):
    return pixels.downsample(fx.rasters(spark, d), 1.5)


@_query
def math_8_slices(spark, d):
    return slicing.plan_slices(pixels.image_sizes(fx.rasters(spark, d)), fx.SLICE, fx.OVERLAP, 2)


@_query
def math_9_mercator(spark, d):
    return _points(spark, d).select("image_id", "cx", "cy")


@_query
def math_10_disc_area(spark, d):
    box = [F.col("image_id") % 31 - 20.0, F.col("image_id") % 37 - 22.0]
    boxes = fx.survey(spark, d).select("image_id", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), box[0].alias("x0"), box[1].alias("y0"), (box[0] + 9).alias("x1"), (box[1] + 14).alias("y1"))
    return geo.disc_cell_area(boxes).select("image_id", "area")


@_query
def math_11_grid(spark, d):
    return heat.make_grid(heat.total_bounds(_points(spark, d))).select("grid_id", "ix", "iy", "x0", "y0")


@_query
def math_12_pad(spark, d):
    return slicing.pad_slices(fx.sliced(spark, d), 2).select("image", "slice_id", "sy", "sx", "r", "g", "b", F.col("L").alias("lab_l"))


@_query
def math_12_unpad(spark, d):
    px = fx.rasters(spark, d)
    plan = slicing.plan_slices(pixels.image_sizes(px), fx.SLICE, fx.OVERLAP)
    padded = slicing.pad_slices(fx.sliced(spark, d), 2).select("image", "slice_id", "sy", "sx", (F.col("L") > 47).alias("is_water"))
    return slicing.unpad_masks(padded, plan, 2)


@_query
def math_14_normalize(spark, d):
    return color.normalize_rgb(fx.rasters(spark, d)).select("image", "y", "x", "nr", "ng", "nb")


def _routes(spark, d):
    px, flagged, chosen = fx.sliced(spark, d), fx.flagged(spark, d), points.require_points(fx.filtered(spark, d), fx.candidates(spark, d), 100)
    plan = slicing.plan_slices(pixels.image_sizes(fx.rasters(spark, d)), fx.SLICE, fx.OVERLAP)
    return segment.route_slices(plan, cells.slice_shortcut(flagged), chosen, cells.slice_fallback(px, 46.0, 12.0))


@_query
def udf_1_routes(spark, d):
    return _routes(spark, d).select("image", "slice_id", "route")


@_query
def udf_2_predict_masks(spark, d):
    """The rasters as slices of bytes, in batches across images, by a model that each worker loads."""
    slices = raster_source.pack_rasters(fx.rasters(spark, d))
    return segment.predict_masks(slices, segment.color_mask(tuple(fx.WATER.values()), 14.0)).select("image", "n_water")


@_query
def set_1_combine_routes(spark, d):
    routes = _routes(spark, d).where("route <> 'model'").select("image", "slice_id", "route", "all_water")
    flat = fx.sliced(spark, d).select("image", "slice_id", "y", "x", color.distance().alias("dist"))
    constant = flat.join(routes, ["image", "slice_id"]).select("image", "slice_id", "y", "x", ((F.col("route") == "shortcut") | F.col("all_water")).alias("is_water"))
    model = flat.join(routes, ["image", "slice_id"], "left_anti").select("image", "slice_id", "y", "x", (F.col("dist") <= 8).alias("is_water"))
    return segment.combine_routes(constant, model)


@_query
def src_1_read_survey(spark, d):
    return tables.read_survey(spark, tables.write_survey_csv(fx.survey(spark, d))).selectExpr("`$id` as image_id", "`$name` as image_name", "latitude", "longitude")


def _image_files(spark, d):
    """The derived rasters written as image files by the tasks; gives the folder."""
    path = temporary(spark, "images")
    rows = raster_source.pack_rasters(fx.rasters(spark, d))
    raster_source.write_images(rows.withColumn("image", F.concat(F.lit("image_"), "image")), path).write.format("noop").mode("overwrite").save()
    return path


@_query
def src_2_list_images(spark, d):
    return tables.list_images(spark, _image_files(spark, d), (".jpg", ".PNG")).select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("length") > 0).alias("full"))


@_query
def src_3_read_rasters(spark, d):
    """The rasters as image files, decoded again."""
    read = raster_source.read_rasters(spark, _image_files(spark, d))
    return raster_source.explode_pixels(read.withColumn("image", F.regexp_extract("image", "image_([0-9]+)", 1).cast("int")))


@_query
def src_4_explode_pixels(spark, d):
    return raster_source.explode_pixels(raster_source.pack_rasters(fx.rasters(spark, d)))


@_query
def src_5_site_colors(spark, d):
    return tables.read_site_colors(spark, tables.write_site_colors(_colors(spark, d)))


@_query
def src_6_results_document(spark, d):
    return tables.read_results(spark, tables.write_documents(survey.result_rows(fx.survey(spark, d)), "analyze", {"slice_size": "1024"}), multi_line=False)


@_query
def src_7_write_results(spark, d):
    rows = naming.with_site_name(survey.result_rows(fx.survey(spark, d))).withColumns({"site": F.coalesce("site_name", F.lit("none")), "run_hash": F.lit("4005f6fd")}).drop("site_name")
    return spark.read.parquet(tables.write_results(rows)).select("image_id", "image_name", "coverage_percentage", F.col("site").cast("string").alias("site"))


@_query
def src_8_mask_bytes(spark, d):
    return masks.mask_to_bytes(fx.fine(spark, d)).select("image", "y", "x", "value")


@_query
def src_8_write_masks(spark, d):
    return raster_source.read_masks(spark, raster_source.write_masks(fx.fine(spark, d), temporary(spark, "masks")))


@_query
def src_9_split_errors(spark, d):
    rows = fx.survey(spark, d).withColumn("error", F.when(F.col("latitude").isNull(), F.concat(F.lit("no position: "), "image_name")))
    ok, errors = tables.split_errors(rows)
    return ok.select("image_id", F.lit("ok").alias("state")).unionAll(errors.select("image_id", F.col("error").alias("state")))


@_query
def src_9_task_errors(spark, d):
    """Every fifth raster is cut short, so its task fails on it: an error row, and coverage of all others."""
    cut_short = F.when(F.col("image") % 5 == 2, F.substring("data", 1, 10)).otherwise(F.col("data"))
    given = raster_source.pack_rasters(fx.rasters(spark, d)).withColumn("data", cut_short.cast("binary"))
    found = blocks.coverage(given.withColumns({c: F.lit(v) for c, v in fx.WATER.items()}), 64, hierarchical=False, uniformity=False, threshold=14, threshold_max=14, num_points=1, errors=True)
    ok, failed = tables.split_errors(cut(found))
    return ok.select(F.col("image").cast("int").alias("image"), "coverage_percentage").unionAll(failed.select(F.col("image").cast("int"), F.lit(-1.0)))


def _watched(spark, d, runs):
    """A store after runs of (rows to add as files, process, overwrite) over one folder, three files at a time. Images of one name share a file, so that no chance decides which of them counts."""
    base = temporary(spark, "watch")
    for rows, process, overwrite in runs:
        if rows is not None:
            rows.select("image_name", "image_id").repartition(8, "image_name").write.mode("append").parquet(f"{base}/in")
        watch(spark, f"{base}/in", "image_name string, image_id long", f"{base}/store", f"{base}/state", process, 3, overwrite=overwrite).awaitTermination()
    return ResultStore(spark, f"{base}/store").read()


def _failing(rows):
    return rows.withColumn("error", F.when(F.col("image_id") % 7 == 0, F.concat(F.lit("failed: "), "image_name")))


def _sound(rows):
    return rows.withColumn("error", F.lit(None).cast("string"))


@_query
def inc_1_watch(spark, d):
    """The survey as files: a run in which a seventh of the images fails, one that tries them again, and one that overwrites an eleventh. Each image is one row, the newest; of images of one name in one run that of the least id counts."""
    rows = fx.survey(spark, d)
    again = rows.where("image_id % 11 = 0").withColumn("image_id", F.col("image_id") + 1_000_000)
    return _watched(spark, d, [(rows, _failing, False), (None, _sound, False), (again, _sound, True)]).select("image_name", "image_id", "error")


@_query
def inc_1_errors(spark, d):
    """After a run with failures and a restart that fails again, the failed images are error rows and no results. Of images of one name that of the least id counts."""
    found = _watched(spark, d, [(fx.survey(spark, d), _failing, False), (None, _failing, False)])
    ok, errors = tables.split_errors(found)
    return ok.select("image_name", F.lit("ok").alias("state")).unionAll(errors.select("image_name", F.col("error").alias("state")))
