"""Metadata, colours and results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import temporary


def _path(spark: SparkSession, path: str | None) -> str:
    return path or temporary(spark, "table")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """The metadata CSV with its header and 26 columns; names that start with $ need backticks."""
    return spark.read.schema(schemas.SURVEY_FILE).csv(path, header=True)


def write_survey_csv(df: DataFrame, path: str | None = None) -> str:
    """image_id, image_name, latitude and longitude in the form of the metadata CSV; gives the path."""
    path = _path(df.sparkSession, path)
    known = {"$id": "image_id", "$name": "image_name", "latitude": "latitude", "longitude": "longitude"}
    df.select(*[(F.col(known[f.name]) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SURVEY_FILE]).write.csv(path, header=True)
    return path


def list_images(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """path and length of files by suffix in any case, in path order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length")
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s.lower())
    return files.where(wanted).orderBy("path")


def write_site_colors(df: DataFrame, path: str | None = None) -> str:
    """location, L, A, B; locations without a colour are left out."""
    path = _path(df.sparkSession, path)
    df.select("location", "L", "A", "B").na.drop().write.csv(path, header=True)
    return path


def read_site_colors(spark: SparkSession, path: str) -> DataFrame:
    """Values are cut to integers; a missing file gives an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schemas.SITE_COLORS)
    rows = spark.read.schema("location string, L double, A double, B double").csv(path, header=True)
    return rows.select("location", *[F.col(c).cast("int").alias(c) for c in "LAB"])


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row a result of the results documents; a document that can't be read, or without results, has none. multi_line: a file is one document, else each line is."""
    return spark.read.schema(schemas.RESULTS_DOCUMENT).option("multiLine", multi_line).json(path).select(F.explode("results").alias("r")).select("r.*")


def write_results(df: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    """Results by site and run_hash; a rewrite replaces only the sites and runs that df holds."""
    path = _path(df.sparkSession, path)
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("site", "run_hash").parquet(path)
    return path


#: The results of a document lie in one array of one row: a site's, or where no site is named a part of about a hundred thousandth of them.
PARTS = 100_000


def documents(df: DataFrame, command: str, run_args: dict[str, str], existing: DataFrame | None = None, by: str | Column | None = None) -> DataFrame:
    """A results document for each group: the command and arguments of the first run stay.

    existing: site, command, run_args. The results of one site make one document by the format;
    without `by` the names are dealt into PARTS documents.
    """
    key = by if by is not None else F.pmod(F.xxhash64("image_name"), F.lit(PARTS)).cast("string")
    rows = df.groupBy((F.col(key) if isinstance(key, str) else key).alias("site")).agg(F.array_sort(F.collect_list(F.struct(*schemas.RESULT.names))).alias("results"))
    args = F.create_map(*[F.lit(x) for pair in run_args.items() for x in pair])
    if existing is None:
        return rows.select("site", F.lit(command).alias("command"), args.alias("run_args"), "results")
    return rows.join(existing.select("site", F.col("command").alias("c"), F.col("run_args").alias("a")), "site", "left").select("site", F.coalesce("c", F.lit(command)).alias("command"), F.coalesce("a", args).alias("run_args"), "results")


def write_documents(df: DataFrame, command: str, run_args: dict[str, str], path: str | None = None, by: str | Column | None = None) -> str:
    """The documents as JSON lines, one a site (default: see documents())."""
    path = _path(df.sparkSession, path)
    documents(df, command, run_args, by=by).select("command", "run_args", "results").write.json(path)
    return path


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one), by the column error."""
    return df.where("error is null").drop("error"), df.where("error is not null")
