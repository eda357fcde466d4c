"""What image names and run parameters say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(name: str | Column) -> Column:
    return F.split(F.col(name) if isinstance(name, str) else name, "_")


def location(name: str | Column = "image_name") -> Column:
    """The first two parts of a name of at least three, else null."""
    p = _parts(name)
    return F.when(F.size(p) >= 3, F.concat_ws("_", F.get(p, 0), F.get(p, 1)))


def with_location(df: DataFrame, name: str = "image_name") -> DataFrame:
    return df.withColumn("location", location(name))


def drop_unlocated(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["location"])


def with_site_name(df: DataFrame, name: str = "image_name") -> DataFrame:
    p = _parts(name)
    return df.withColumn("site_name", F.when(F.size(p) >= 3, F.get(p, 2)))


def site_name(df: DataFrame, path: str = "image_name") -> DataFrame:
    """One row a location: the site name of its first image in path order."""
    return with_site_name(df, path).groupBy("location").agg(F.min_by("site_name", path).alias("site_name"))


def title_token(df: DataFrame, by: str = "location", order: str = "image_id", name: str = "image_name") -> DataFrame:
    """One row a group: the second part of the name in its first row."""
    return df.groupBy(by).agg(F.min_by(F.get(_parts(name), 1), order).alias("title"))


def with_num_id(df: DataFrame, name: str = "image_name") -> DataFrame:
    """The last part of the name without "DSC" and ".JPG"."""
    return df.withColumn("num_id", F.regexp_replace(F.element_at(_parts(name), -1), r"DSC|\.JPG", ""))


def with_basename(df: DataFrame, path: str = "path") -> DataFrame:
    base = F.element_at(F.split(path, "/"), -1)
    return df.withColumns({"basename": base, "stem": F.regexp_replace(base, r"\.[^.]*$", "")})


#: Parameters of a run, and those that only a hierarchical run has. The names are hashed.
RUN_KEYS = "slice_size slice_overlap padding clahe downsample_factor num_points threshold threshold_max final_point_strategy grid_size uniformity_check uniformity_std_threshold uniform_grid_thresh water_grid_thresh fallback_brightness_threshold fallback_distance_threshold hierarchical".split()
HIERARCHICAL_KEYS = "hierarchical_slice_size use_erosion_merge erosion_kernel_size use_color_validation color_validation_threshold merge_color_threshold merge_lightness_threshold".split()


def run_hash(params: DataFrame) -> DataFrame:
    """params and run_hash: eight hex digits of the SHA-256 of the run's parameters as JSON with sorted keys.

    A row whose `hierarchical` is true also hashes HIERARCHICAL_KEYS. Parameters that params lacks are left out.
    """
    kinds = dict(params.dtypes)

    def value(key: str) -> Column:
        c = F.col(key)
        text = F.concat(F.lit('"'), c, F.lit('"')) if kinds[key] == "string" else c.cast("string")
        return F.concat(F.lit(f'"{key}": '), F.coalesce(text, F.lit("null")))

    def joined(keys: list[str]) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(", ", *[value(k) for k in sorted(keys) if k in kinds]), F.lit("}"))

    text = F.when(F.col("hierarchical"), joined(RUN_KEYS + HIERARCHICAL_KEYS)).otherwise(joined(RUN_KEYS))
    return params.withColumn("run_hash", F.substring(F.sha2(text, 256), 1, 8))
