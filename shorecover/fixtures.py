"""Relations that Spark derives from the given tables, to run the operators on.

survey stands in for metadata and results, pixels are rasters made from embeddings, samples are
pixel samples of sites. The same text runs in DuckDB where SURVEY and SAMPLES are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color
from .operators import cells, masks, pixels, points, slicing

SURVEY = """select o_orderkey as image_id,
  case when o_orderkey % 50 = 0 then concat('stray', o_orderkey, '.JPG')
       else concat('drone-', o_custkey % 3, '_', year(o_orderdate), '_Cove', o_custkey % 5,
                   '_DSC', lpad(cast(o_orderkey as varchar(20)), 6, '0'), '.JPG') end as image_name,
  case when o_orderkey % 40 = 7 then null else 36.9e0 + (o_custkey % 997) / 5e4 end as latitude,
  case when o_orderkey % 40 = 7 then null else 122e0 + (o_orderkey % 991) / 5e4 end as longitude,
  cast(round(o_totalprice * 100) as bigint) % 10001 / 1e2 as coverage_percentage
from orders"""

SAMPLES = """select concat('site_', l_suppkey % 7) as location, l_orderkey % 50 as image,
  cast((l_partkey*31)%256 as int) as r, cast((l_suppkey*17+l_linenumber*29)%256 as int) as g,
  cast(l_quantity*5 as int)%256 as b
from lineitem"""

PIXELS = """with p as (select cast(vec_id div 64 as int) as image, cast(vec_id % 64 as int) as y, x,
    cast(embedding[x] as double) e0, cast(embedding[(x+21)%64] as double) e1, cast(embedding[(x+42)%64] as double) e2
  from (select *, explode(sequence(0,63)) as x from embeddings) u)
select image, y, x,
  cast(least(greatest(floor(70e0 + case when image % 4 = 3 then 100 else 0 end + amp * e0), 0), 255) as int) as r,
  cast(least(greatest(floor(120e0 + amp * e1), 0), 255) as int) as g,
  cast(least(greatest(floor(130e0 + amp * e2), 0), 255) as int) as b
from (select *, case when y < 16 then 12e0 when y < 32 then 30e0 when y < 48 then 60e0 else 200e0 end as amp from p) q"""

#: The fixed water colour of the rasters, and the small sizes they are worked on with.
WATER = {"water_l": 47.25, "water_a": -14.0, "water_b": -10.7}
SLICE, OVERLAP, CELL, KERNEL, SEED = 32, 0.2, 8, 5, 7


def _derived(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", "from {" + table + "}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, SURVEY, "orders")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, SAMPLES, "lineitem")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PIXELS, "embeddings")


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with L, a, b_ and the fixed water colour."""
    return color.rgb_to_lab(rasters(spark, sf_dir)).withColumns({k: F.lit(v) for k, v in WATER.items()})


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lab(spark, sf_dir)
    return slicing.assign_slices(px, pixels.image_sizes(px), SLICE, OVERLAP)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cells.cell_stats(sliced(spark, sf_dir), CELL)
    return cells.cell_flags(stats.withColumns({k: F.lit(v) for k, v in WATER.items()}), 4.0, 10.0)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.candidate_pixels(sliced(spark, sf_dir), flagged(spark, sf_dir), CELL)


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.one_per_cell(candidates(spark, sf_dir), CELL, SEED)


def slice_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask for each slice whose limit varies with the slice, so that overlaps disagree."""
    return sliced(spark, sf_dir).select("image", "slice_id", "y", "x", (color.distance() <= 6 + 2 * (F.col("slice_id") % 4)).alias("is_water"))


def fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.merge_masks(slice_masks(spark, sf_dir), rasters(spark, sf_dir), "OR")


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab(spark, sf_dir).select("image", "y", "x", (color.distance() <= 14).alias("is_water"))
