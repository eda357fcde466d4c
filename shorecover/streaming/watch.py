"""Incremental processing: what is not yet done, in small saved batches, restartable."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.survey import pending_results
from ..session import cut
from ..sources.store import KEY, ResultStore

Process = Callable[[DataFrame], DataFrame]
#: Records of batches after which the store is rewritten as one.
COMPACT = 50
_SOURCE, _TIME = "__source", "__time"


def _with_source(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias(_SOURCE), F.col("_metadata.file_modification_time").alias(_TIME))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint, so that its batch numbers are told from those of another."""
    spark_path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/stream-id")
    files = spark_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark_path):
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(spark_path, uuid.uuid4().hex))
    return files.listStatus(spark_path)[0].getPath().getName()


def _one_a_name(rows: DataFrame) -> DataFrame:
    """Of rows of one name the least by their other columns, so that the choice does not hang on the order of rows. Columns that have no order are compared as JSON."""
    others = [c for c in rows.columns if c != KEY]
    if not others:
        return rows.distinct()
    unordered = {c for c, t in rows.dtypes if re.search(r"\b(map<|variant\b)", t)}
    row = F.struct(*others)
    least = F.min_by(row, F.struct(*[F.to_json(F.struct(c)) if c in unordered else F.col(c) for c in others])) if unordered else F.min(row)
    return rows.groupBy(KEY).agg(least.alias("__row")).select(*[F.col(c if c == KEY else f"__row.{c}").alias(c) for c in rows.columns])


def _work_off(rows: DataFrame, store: ResultStore, stream: str, number: int, process: Process, overwrite: bool) -> None:
    """Processes the rows of a batch that have no result and saves them with their file; of rows of one name that of the newest file counts, of those in one file the least."""
    if store.has(stream, number):
        return
    newest = rows.groupBy(KEY).agg(F.max(F.struct(_TIME, _SOURCE)).alias("f")).select(KEY, F.col(f"f.{_TIME}").alias(_TIME), F.col(f"f.{_SOURCE}").alias(_SOURCE))
    old = store.read()
    if old is not None:
        newest = pending_results(newest, old.where("error is null"), overwrite)
    newest = cut(newest)
    given = _one_a_name(rows.join(newest, [KEY, _TIME, _SOURCE], "left_semi").drop(_TIME, _SOURCE))
    found = process(given)
    store.save(found.join(newest.select(KEY, F.col(_SOURCE).alias("source")), KEY, "left"), stream, number)
    if len(store.commits()) > COMPACT:
        store.compact()


def retry(spark: SparkSession, schema: str, store: ResultStore, process: Process, batch: int = 25, file_format: str = "parquet", prepare: Process | None = None) -> None:
    """Processes the images that stand with an error once more, from the files they came from, `batch` files at a time; files that are gone are passed over."""
    old = store.read()
    if old is None:
        return
    failed = cut(old.where("error is not null and source is not null").select(KEY, F.col("source").alias(_SOURCE)))
    stream, number, last = f"retry-{uuid.uuid4().hex}", 0, ""
    while True:
        names = [r[0] for r in failed.where(F.col(_SOURCE) > last).select(_SOURCE).distinct().orderBy(_SOURCE).limit(batch).collect()]
        if not names:
            return
        last = names[-1]
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(n)) for n in names if _exists(spark, unquote(n))]
        if paths:
            rows = _with_source(spark.read.schema(schema).format(file_format).load(paths))
            rows = prepare(rows) if prepare else rows
            _work_off(rows.join(failed, [KEY, _SOURCE], "left_semi"), store, stream, number, process, False)
            number += 1


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def watch(
    spark: SparkSession, in_dir: str, schema: str, out_dir: str, checkpoint: str, process: Process, batch: int = 25, file_format: str = "parquet", overwrite: bool = False, prepare: Process | None = None,
) -> StreamingQuery:
    """Works off the files of in_dir that no earlier run has, `batch` at a time, and upserts the results of process() into the store in out_dir (see ResultStore).

    process gets rows with image_name and gives results with image_name and error (null if fine),
    a row a name. A name with a result is skipped, with overwrite it is done again and replaced; one with an
    error is no result: it is tried again at each start, and when it comes again. A batch that
    runs again after a failure is saved once. prepare: rows of the files to rows with image_name;
    it must keep the columns that begin with two underscores.
    """
    store = ResultStore(spark, out_dir)
    retry(spark, schema, store, process, batch, file_format, prepare)
    stream = _stream_id(spark, checkpoint)

    def save(rows: DataFrame, number: int) -> None:
        _work_off(rows, ResultStore(rows.sparkSession, out_dir), stream, number, process, overwrite)

    rows = _with_source(spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", batch).load(in_dir))
    rows = prepare(rows) if prepare else rows
    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
