"""Tables of images: selection, sampling, lookup, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import lab_decode8
from .ranks import ranked


def order_hash(seed: int, *keys: str) -> Column:
    """A reproducible random order: the MD5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(seed: int, *keys: str) -> Column:
    """A reproducible uniform number of [0, 1)."""
    return F.conv(F.substring(order_hash(seed, *keys), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def pick_images(df: DataFrame, names: DataFrame, name: str = "image_name") -> DataFrame:
    """names: one column of comma lists. The images named, each with its place (pos) in the list; unknown names are dropped."""
    column = names.columns[0]
    wanted = names.select(F.posexplode(F.split(column, ",")).alias("pos", "n")).select("pos", F.trim("n").alias(name))
    return wanted.join(df, name)


def pick_sites(df: DataFrame, site_colors: DataFrame, site: str | None = None) -> DataFrame:
    """Rows of known locations, or of one of them."""
    known = site_colors.select("location").distinct()
    return df.join(known if site is None else known.where(F.col("location") == site), "location", "left_semi")


def slice_per_location(df: DataFrame, start: int | None, end: int | None, by: str = "location", order: str = "image_id") -> DataFrame:
    """Rows start to end of each location by id; negative numbers count from its end.

    Ranks come from ranges of (location, id), so no task holds a location. A null location is one
    like any other; rows equal in all columns are interchangeable.
    """
    rows = ranked(df, [by], [order])
    at = lambda v: F.lit(v) if v >= 0 else F.greatest(F.col("__all") + v, F.lit(0))
    if start is not None:
        rows = rows.where(F.col("__n") >= at(start))
    if end is not None:
        rows = rows.where(F.col("__n") < at(end))
    return rows.drop("__n", "__all")


def sample_per_location(df: DataFrame, n: int, seed: int = 0, by: str = "location", key: str = "image_id") -> DataFrame:
    """n rows of each location, without repeats, in a reproducible random choice; all rows for n = -1 or a smaller location."""
    if n == -1:
        return df
    order = Window.partitionBy(by).orderBy(order_hash(seed, key), key)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def sample_images(df: DataFrame, count: int, seed: int = 0, by: str = "site_name", path: str = "image_name") -> DataFrame:
    """count images of each site in a reproducible random choice; -1: all; other negative counts leave so many off the end."""
    if count < -1:
        return slice_per_location(df, None, count, by, path)
    return sample_per_location(df, count, seed, by, path)


def first_per_name(survey: DataFrame, name: str = "image_name", order: str = "image_id") -> DataFrame:
    """One metadata row a name: that of the smallest id (files have no row order here)."""
    others = [c for c in survey.columns if c not in (name, order)]
    first = survey.groupBy(name).agg(F.min_by(F.struct(order, *others), order).alias("__first"))
    return first.select(name, F.col(f"__first.{order}").alias(order), *[F.col(f"__first.{c}").alias(c) for c in others])


def attach_metadata(results: DataFrame, survey: DataFrame, name: str = "image_name") -> DataFrame:
    """Left join on the name; nulls for a name without metadata."""
    return results.join(first_per_name(survey, name), name, "left")


def pending_images(selected: DataFrame, existing: DataFrame) -> DataFrame:
    return selected.join(existing, ["location", "image_name"], "left_anti")


def pending_results(images: DataFrame, results: DataFrame, overwrite: bool = False) -> DataFrame:
    """Images without a result; all of them if results are overwritten."""
    return images if overwrite else images.join(results, "image_name", "left_anti")


def upsert_results(old: DataFrame, new: DataFrame, key: str = "image_name") -> DataFrame:
    """New rows in place of old ones of the same name, other old rows kept."""
    return old.join(new, key, "left_anti").unionByName(new)


def with_water(df: DataFrame, site_colors: DataFrame) -> DataFrame:
    """The decoded water colour of each row's location; rows of locations without one are dropped."""
    return df.join(lab_decode8(site_colors).select("location", "water_l", "water_a", "water_b"), "location")


def result_rows(df: DataFrame) -> DataFrame:
    kinds = {"image_name": "string", "image_id": "long", "latitude": "double", "longitude": "double", "coverage_percentage": "double"}
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
