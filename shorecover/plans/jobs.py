"""The three workloads as one plan each."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import blocks, schemas
from ..functions import color, geo, naming
from ..operators import cells, heat, masks, pixels, points, reports, segment, slicing, survey
from ..session import cut
from ..sources import rasters, tables
from ..sources.store import ResultStore
from ..streaming.watch import watch


def calibrate(samples: DataFrame) -> DataFrame:
    """The water colour of each location from pixel samples (location, r, g, b)."""
    return pixels.site_colors(color.lab_encode8(color.rgb_to_lab(samples)))


def heatmap(results: DataFrame, cell: float = geo.CELL, by: tuple[str, ...] = ()) -> DataFrame:
    """The area-weighted coverage of each touched grid cell; rows without coordinates have no part.

    Only touched cells are made, so far-apart sites cost no empty grid; `by` keeps sites apart.
    """
    p = geo.to_mercator(geo.west_longitude(results)).where("cx is not null and cy is not null")
    return heat.weighted_grid(heat.overlay(p, heat.total_bounds(p, by=by), cell, by=by), by=by)


def _prompted(px: DataFrame, size: int, overlap: float, grid: int, uniform_std: float, threshold_max: float, num_points: int, seed: int, padding: int = 0, uniformity: bool = True):
    """Pixels of slices, flagged cells and what is left to choose from are written tables, as several steps read them: (image sizes, slice pixels, the same with their border, flagged cells, candidates, candidates left to choose from)."""
    sizes = pixels.image_sizes(px)
    rows = cut(slicing.assign_slices(px, sizes, size, overlap, padding))
    padded = cut(slicing.with_border(rows, padding)) if padding else rows
    water = px.groupBy("image").agg(*[F.first(c).alias(c) for c in ("water_l", "water_a", "water_b")])
    flagged = cut(cells.cell_flags(cells.cell_stats(padded, grid).join(water, "image"), uniform_std, threshold_max))
    if uniformity:
        found = cells.candidate_pixels(padded, flagged, grid)
        left = points.one_per_cell(found, grid, seed)
    else:
        flagged = flagged.limit(0)
        left = found = cells.pixel_candidates(padded, threshold_max)
    return sizes, rows, padded, flagged, found, cut(points.require_points(left, found, num_points))


def one_pass(
    px: DataFrame, size: int, overlap: float, grid: int, logic: str, uniform_std: float = 4.0, threshold_max: float = 20, threshold: float = 20, num_points: int = 3, seed: int = 0,
    padding: int = 0, uniformity: bool = True, strategy: str = "random", uniform_share: float = 0.98, water_share: float = 0.98, brightness: float = 100.0, max_distance: float = 55.0,
) -> DataFrame:
    """The water mask of one pass: slices are routed, masked (the model is the colour test) and merged. px has L, a, b_ and the water colour.

    uniformity off: candidates are the pixels near the water colour, and no slice takes the
    shortcut. For a model of one's own on whole rasters see blocks.coverage().
    """
    sizes, rows, padded, flagged, _, kept = _prompted(px, size, overlap, grid, uniform_std, threshold_max, num_points, seed, padding, uniformity)
    plan = slicing.plan_slices(sizes, size, overlap, padding)
    chosen = points.choose_points(kept, strategy, num_points, seed, size)
    routes = cut(segment.route_slices(plan, cells.slice_shortcut(flagged, uniform_share, water_share), chosen, cells.slice_fallback(padded, brightness, max_distance)))
    joined = rows.join(routes.select("image", "slice_id", "route", "all_water"), ["image", "slice_id"])
    water = F.when(F.col("route") == "shortcut", True).when(F.col("route") == "fallback", F.col("all_water")).otherwise(color.distance() <= threshold)
    return masks.merge_masks(joined.select("image", "slice_id", "y", "x", water.alias("is_water")), px, logic)


def coverage(
    px: DataFrame, size: int = 1024, coarse_size: int = 4096, overlap: float = 0.2, grid: int = 64, kernel: int = 51, color_threshold: float = 15, lightness: float = 75.0,
    erosion: bool = True, validation: bool = True, hierarchical: bool = True, **options,
) -> DataFrame:
    """coverage_percentage of each image: fine slices by OR; coarse ones by AND, their kelp eroded; compared and checked by colour.

    erosion, validation: the switches of the two later steps. hierarchical off: the fine pass
    alone. options: those of one_pass().
    """
    px = cut(px)
    fine = one_pass(px, size, overlap, grid, "OR", **options)
    if not hierarchical:
        return masks.coverage(fine)
    coarse = one_pass(px, coarse_size, overlap, grid, "AND", **options)
    if erosion:
        coarse = masks.erode(coarse, kernel)
    return masks.coverage(masks.merge_passes(fine, coarse, px if validation else None, color_threshold, lightness))


def diagnose(
    px: DataFrame, size: int = 1024, overlap: float = 0.2, grid: int = 64, uniform_std: float = 4.0, threshold_max: float = 20, num_points: int = 3, seed: int = 0,
    padding: int = 0, uniformity: bool = True, strategy: str = "random",
) -> DataFrame:
    """Counts of cells, candidates and points of each slice; for whole rasters see debug_slices()."""
    sizes, _, _, flagged, found, kept = _prompted(px, size, overlap, grid, uniform_std, threshold_max, num_points, seed, padding, uniformity)
    filtered = points.one_per_cell(found, grid, seed) if uniformity else found
    return cells.slice_diagnostics(flagged, found, filtered, points.choose_points(kept, strategy, num_points, seed, size), threshold_max, slicing.plan_slices(sizes, size, overlap, padding))


def debug_slices(rasters: DataFrame, site_colors: DataFrame, site: str | None = None, slices: Collection[int] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(reports, errors): what the job sees in chosen slices of decoded rasters (see sources.read_rasters), before any model.

    site: the location whose water colour counts for all of them; without it that of each image's
    name. A raster that is no image, one without a colour and one that fails are error rows
    (image_name, error). slices, options and the columns of reports: those of
    operators.reports.slice_reports().
    """
    rows = rasters.withColumn("image_name", F.col("image"))
    rows = naming.with_location(rows, "image_name") if site is None else rows.withColumn("location", F.lit(site))
    ok, unfit = _fit(rows, site_colors)
    found = cut(reports.slice_reports(ok, slices, errors=True, **options))
    seen, failed = tables.split_errors(found.withColumnRenamed("image", "image_name"))
    return seen, unfit.select("image_name", "error").unionAll(failed.select("image_name", "error"))


def _fit(rows: DataFrame, site_colors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rasters with a location as (those that can be worked on, with their water colour; the others with error)."""
    water = color.lab_decode8(site_colors).select("location", "water_l", "water_a", "water_b")
    rows = rows.join(water, "location", "left")
    error = F.when(F.col("height") <= 0, "not an image").when(F.col("location").isNull(), "no location in the name").when(F.col("water_l").isNull(), F.concat(F.lit("no water colour for "), "location"))
    return tables.split_errors(rows.withColumn("error", error))


def analyze(rasters: DataFrame, site_colors: DataFrame, survey_rows: DataFrame, known: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of decoded rasters (see sources.read_rasters): location from the name, water colour, coverage, metadata.

    A raster that could not be decoded, one without a location, one whose location has no
    colour, and one on which the work or the model fails in its task, are error rows (image_name,
    error); the others go on. Coverage is computed once, written, and split into both. known: results of earlier runs; their images are
    skipped and their rows kept. options: those of blocks.coverage().
    """
    named = naming.with_location(rasters.withColumn("image_name", F.col("image")), "image_name")
    if known is not None:
        named = survey.pending_results(named, known)
    ok, unfit = _fit(named, site_colors)
    found, failed = tables.split_errors(cut(blocks.coverage(ok, errors=True, **options).withColumnRenamed("image", "image_name")))
    results = survey.result_rows(survey.attach_metadata(found, survey_rows.select("image_name", "image_id", "latitude", "longitude")))
    if known is not None:
        results = survey.upsert_results(known.select(results.columns), results)
    return results, unfit.select("image_name", "error").unionAll(failed.select("image_name", "error"))


def select_images(listed: DataFrame, site_colors: DataFrame, site: str | None = None, images: str | None = None, count: int = -1, seed: int = 0) -> DataFrame:
    """path, image_name, location of the images to work on, of a list of paths (sources.list_images).

    Only images of locations with a colour count, or of the one `site`; an unknown site has none.
    images: a comma list of names, unknown ones dropped. Without it, `count` images of each location
    in a reproducible choice by the name, all for -1.
    """
    named = naming.with_location(listed.withColumn("image_name", F.element_at(F.split("path", "/"), -1)))
    rows = survey.pick_sites(named, site_colors, site).select("path", "image_name", "location")
    if images is None:
        return survey.sample_images(rows, count, seed, "location", "image_name")
    names = listed.sparkSession.createDataFrame([(images,)], "names string")
    return rows.join(survey.pick_images(rows.select("image_name").distinct(), names).select("image_name"), "image_name", "left_semi")


def analyze_sites(
    spark: SparkSession, directory: str, site_colors: DataFrame, survey_rows: DataFrame, site: str | None = None, images: str | None = None, count: int = -1, seed: int = 0,
    known: DataFrame | None = None, overwrite: bool = False, **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, errors, sites) of a folder of images, all its sites in one plan.

    Images are chosen from the file list (see select_images); the image reader decodes the
    whole folder, and only the chosen ones are worked on. sites:
    location, site_name (of its first image), n_images chosen. overwrite: the chosen images are
    worked on again although they are known; results of others are kept. options: those of analyze().
    """
    chosen = cut(select_images(tables.list_images(spark, directory), site_colors, site, images, count, seed))
    sites = naming.site_name(chosen).join(chosen.groupBy("location").agg(F.count("*").alias("n_images")), "location")
    # the two readers write file paths with one and with three slashes
    key = lambda c: F.regexp_replace(c, ":/+", ":/").alias("key")
    read = rasters.read_rasters(spark, directory, drop_invalid=False)
    picked = read.withColumn("key", key("path")).join(chosen.select(key("path")), "key", "left_semi").drop("key")
    results, errors = analyze(picked, site_colors, survey_rows, None if overwrite else known, **options)
    if overwrite and known is not None:
        results = survey.upsert_results(known.select(results.columns), results)
    return results, errors, sites


#: Streamed rasters: the columns of sources.read_rasters() but the path, or image files.
RASTER_ROWS = "image string, height int, width int, n_channels int, data binary"
IMAGE_FILES = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def analyze_stream(
    spark: SparkSession, in_dir: str, store_dir: str, checkpoint: str, site_colors: DataFrame, survey_rows: DataFrame, files: str = "image", batch: int = 25, overwrite: bool = False, **options,
) -> StreamingQuery:
    """analyze() over the files of a folder, `batch` at a time, upserted into the store: a result or an error row for each image.

    files: "image" for image files, "parquet" for rows of RASTER_ROWS. Images with a result are
    skipped, those with an error tried again at each start (see streaming.watch).
    """

    def prepare(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c.startswith("__")]
        if files == "image":
            rows = rows.select(F.element_at(F.split("image.origin", "/"), -1).alias("image"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data", *kept)
        return rows.withColumn("image_name", F.col("image"))

    def process(rows: DataFrame) -> DataFrame:
        results, errors = analyze(rows.drop("image_name"), site_colors, survey_rows, **options)
        return results.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)

    return watch(spark, in_dir, IMAGE_FILES if files == "image" else RASTER_ROWS, store_dir, checkpoint, process, batch, files, overwrite, prepare)


def publish(spark: SparkSession, store_dir: str, command: str, run_args: dict[str, str], path: str | None = None) -> str:
    """The results of a store as documents that carry the command and arguments of the store's first run; gives the path. Error rows are no results."""
    store = ResultStore(spark, store_dir)
    command, run_args = store.first_run(command, run_args)
    rows = store.read()
    rows = spark.createDataFrame([], schemas.RESULT) if rows is None else survey.result_rows(rows.where("error is null"))
    return tables.write_documents(rows, command, run_args, path)
