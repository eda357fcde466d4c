"""Water masks: merging, erosion, comparison, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import off_color
from .pixels import IMAGE

PIXEL = [IMAGE, "y", "x"]


def merge_masks(masks: DataFrame, extent: DataFrame, logic: str = "OR") -> DataFrame:
    """One is_water for each pixel of the extent (image, y, x), from the masks of all slices.

    OR: water if any slice says so, and where no slice is, not. AND: water only if all slices say
    so, and where no slice is, water; an image without any mask is not water at all.
    """
    if logic == "OR":
        merged = masks.groupBy(*PIXEL).agg(F.bool_or("is_water").alias("m"))
        return extent.select(*PIXEL).join(merged, PIXEL, "left").select(*PIXEL, F.coalesce("m", F.lit(False)).alias("is_water"))
    merged = masks.groupBy(*PIXEL).agg(F.bool_and("is_water").alias("m"))
    some = masks.select(IMAGE).distinct().withColumn("some", F.lit(True))
    rows = extent.select(*PIXEL).join(merged, PIXEL, "left").join(some, IMAGE, "left")
    return rows.select(*PIXEL, F.when(F.col("some").isNull(), False).otherwise(F.coalesce("m", F.lit(True))).alias("is_water"))


def coverage(mask: DataFrame) -> DataFrame:
    """coverage_percentage of each image: the share that is not water."""
    return mask.groupBy(IMAGE).agg(((F.count("*") - F.count_if(F.col("is_water"))) / F.count("*") * 100).alias("coverage_percentage"))


def erode(mask: DataFrame, kernel_size: int = 51) -> DataFrame:
    """Kelp stays kelp only if all pixels within the odd square kernel and inside the image are. Rows first, then columns: a window is one line of an image."""
    r = (kernel_size if kernel_size % 2 else kernel_size + 1) // 2
    along = Window.partitionBy(IMAGE, "y").orderBy("x").rangeBetween(-r, r)
    down = Window.partitionBy(IMAGE, "x").orderBy("y").rangeBetween(-r, r)
    rows = mask.withColumn("__k", F.min((~F.col("is_water")).cast("int")).over(along))
    return rows.withColumn("is_water", F.min("__k").over(down) == 0).drop("__k")


def compare_masks(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Kelp of both passes: agreed (both), disputed (one of them)."""
    rows = fine.select(*PIXEL, (~F.col("is_water")).alias("fine")).join(coarse.select(*PIXEL, (~F.col("is_water")).alias("coarse")), PIXEL)
    return rows.select(*PIXEL, "fine", "coarse", (F.col("fine") & F.col("coarse")).alias("agreed"), (F.col("fine") != F.col("coarse")).alias("disputed"))


def merge_passes(fine: DataFrame, coarse: DataFrame, lab: DataFrame | None = None, color_threshold: float = 15, lightness: float = 75.0) -> DataFrame:
    """is_water of both passes: kelp where they agree, and where a disputed pixel's colour says so. Without lab (image, y, x, L, a, b_, water_a, water_b) only where they agree."""
    both = compare_masks(fine, coarse)
    if lab is None:
        return both.select(*PIXEL, "agreed", "disputed", F.lit(False).alias("validated"), (~F.col("agreed")).alias("is_water"))
    rows = both.join(lab.select(*PIXEL, off_color(color_threshold, lightness).alias("off")), PIXEL)
    validated = F.col("disputed") & F.col("off")
    return rows.select(*PIXEL, "agreed", "disputed", validated.alias("validated"), (~(F.col("agreed") | validated)).alias("is_water"))


def merge_report(merged: DataFrame, fine: DataFrame, coarse: DataFrame, coarse_eroded: DataFrame) -> DataFrame:
    """Per image: disputed pixels, those validated, kelp in all, kelp of the coarse pass before and after erosion, coverage of both passes."""
    total = merged.groupBy(IMAGE).agg(F.count_if("disputed").alias("n_disputed"), F.count_if("validated").alias("n_validated"), F.count_if(~F.col("is_water")).alias("n_kelp"))
    kelp = lambda m, name: m.groupBy(IMAGE).agg(F.count_if(~F.col("is_water")).alias(name))
    out = total.join(kelp(coarse, "n_before"), IMAGE).join(kelp(coarse_eroded, "n_after"), IMAGE)
    for m, name in ((fine, "fine_coverage"), (coarse, "coarse_coverage")):
        out = out.join(coverage(m).withColumnRenamed("coverage_percentage", name), IMAGE)
    return out


def mask_to_bytes(mask: DataFrame) -> DataFrame:
    """The inverted mask: 255 for kelp, 0 for water."""
    return mask.withColumn("value", F.when(F.col("is_water"), 0).otherwise(255))
